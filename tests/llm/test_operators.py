"""The corpus operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from statloom.llm import chat, decontaminate, jaccard, language, pii, quality, shard_tree, source_schedule, substring, toxicity
from statloom.llm.graph import components
from statloom.llm.words import Words, chunked, grams, whole
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = prose(120), prose(40)
    out = [(1, base), (2, base), (3, base.replace("w1 ", "W1  ")), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE\ttwo"), (9, prose(3000))]
    for i in range(10, 40):
        own = base.split()
        for j in rng.integers(0, 120, int(rng.integers(0, 7))):
            own[j] = f"x{i}"
        out.append((i, " ".join(own)))
    out += [(i, f"{prose(30)} {passage} {prose(int(rng.integers(1, 60)))}\n{prose(9)}\n{prose(9)}") for i in range(40, 60)]
    out += [(60, "a\x1cb c"), (61, "x" * 70_000), (62, "the end " * 400), (63, "### ??? " * 80), (63, "### ??? " * 80), (None, base), (64, f"{prose(20)} {passage}")]
    return [(d, t, "en" if (d or 0) % 3 else None, None if (d or 0) % 5 == 0 else f"s{(d or 0) % 4}", len(t or "")) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("Shard", F.lit("mine")).withColumn("_slice", F.lit(1)).withColumn("cls", F.lit("x"))
    return extra.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_grams(rows):
    texts = [r[1] for r in rows]
    for _, w in itertools.chain(chunked(pa.array(texts, pa.string())), chunked(pa.array(texts, pa.string()), most=50)):
        assert len(w.bounds) > 1
    got = np.concatenate([w.counts for _, w in chunked(pa.array(texts, pa.string()), most=500)])
    assert got.tolist() == [len(words(t)) for t in texts]
    data = b"aa bb cc aa bb cc dd"
    h = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    for n in range(1, 8):
        g = grams(h, n)
        assert len(g) == 8 - n and (n > 3 or g[0] == g[3]) and len(set(g.tolist())) == (4 if n == 1 else 7 - n + 1 - max(0, 4 - n))
    assert whole(h[:2]) != grams(h, 2)[0] and len(grams(h[:2], 3)) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200) if i % 50] + [(7, 7), (300, 301), (301, 300), (None, 3)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = Counter(got.values())
    assert sorted(groups.values()) == [2, 50, 50, 50, 50] and got[1] == got[50] != got[51]


def test_shard_tree(spark, docs, empty):
    root = shard_tree.tree(16)
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    both = shard_tree.assign(shard_tree.assign(ids, "k", root), "k", shard_tree.grow(root, 16), "grown").toPandas()
    moved = both[both["shard"] != both["grown"]]
    assert set(moved["grown"]) == {16} and 900 < len(moved) < 1500
    assert both["shard"].value_counts().between(1000, 1500).all() and both["shard"].nunique() == 16
    heavy = shard_tree.tree(16, weights={15: 3.0, 3: 0.0})
    after = shard_tree.assign(ids, "k", heavy).toPandas()["shard"]
    assert 3 not in set(after)
    changed = both["shard"][after != both["shard"]]
    stay = ~both["shard"].isin([0, 1, 2, 3]) & ~after.isin([12, 13, 14, 15])
    assert len(changed) and (after[stay] == both["shard"][stay]).mean() > 0.95
    placed = shard_tree.number(shard_tree.assign(docs.drop("Shard"), "doc_id", root), "doc_id", docs.count()).toPandas()
    for _, part in placed.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert len(placed) == docs.count() and "cls" in placed and "_slice" in placed
    assert shard_tree.number(shard_tree.assign(empty, "doc_id", root), "doc_id", 0).count() == 0


def test_source_schedule(docs, rows, empty):
    sized = docs.select("doc_id", "source", source_schedule.word_count(F.col("text")).alias("size"))
    got = source_schedule.blend(sized, block_words=16).toPandas()
    again = source_schedule.blend(sized, block_words=16).toPandas()
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(got) == key(again) and len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len(words(r[1])) for r in rows)
    assert (got["taken"] <= 3 * got["size"]).all()
    total = got["size"].sum()
    for source, part in got.groupby(got["source"].fillna("~")):
        assert part["source_size"].iloc[0] == part["size"].sum()
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 8 * 16
    names = sorted(got["source"].dropna().unique()) + [None]
    bound = {n: 3 * got[got["source"].isna() if n is None else got["source"] == n]["size"].sum() for n in names}
    weight, full = {n: i % 3 + 1 for i, n in enumerate(names)}, set()
    while True:
        rest = total - sum(bound[n] for n in full)
        share = {n: bound[n] if n in full else rest * weight[n] / sum(w for k, w in weight.items() if k not in full) for n in names}
        over = {n for n in names if share[n] > bound[n]} - full
        if not over:
            break
        full |= over
    for n in names:
        assert got[got["source"].isna() if n is None else got["source"] == n]["target"].iloc[0] == pytest.approx(share[n])
    repeated = source_schedule.repeat(docs, block_words=16)
    assert repeated.columns == docs.columns and set(repeated.toPandas()["doc_id"].dropna()) <= {r[0] for r in rows}
    assert source_schedule.blend(empty.select("doc_id", "source", F.lit(0).alias("size"))).count() == 0
    assert source_schedule.repeat(empty).count() == 0


def brute_quality(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_ratio(text, model):
    data = b" ".join(x.encode().lower() for x in words(text))
    found = [model.ratio[((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 17] for i in range(len(data) - 2)]
    return float(np.mean(found)) if found else 0.0


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(d, 1 if d < 60 else 0) for d in range(1, 64)] + [(None, 1), (9_999, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.judge(docs, model).toPandas()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted(brute_quality(r[1]) for r in rows)
    assert sorted(map(tuple, got[names].to_numpy().tolist())) == want
    by_id = {r[0]: r[1] for r in rows}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        if by_id[r.doc_id] and by_id[r.doc_id].isascii():
            assert r.score == pytest.approx(brute_ratio(by_id[r.doc_id], model), abs=1e-9)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
    kept = set(got[got["kept"]]["doc_id"].dropna())
    assert {1, 2, 9, 45} <= kept and not {62, 63} & kept
    assert quality.keep(docs, model).columns == docs.columns and quality.keep(docs, model).count() == got["kept"].sum()
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    live = [(d, shingles(t, n)) for d, t, *_ in rows if d is not None]
    label = {d: d for d, _ in live}
    changed = True
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(live, 2) if x and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {(d, len(x), label[d]) for d, x in live}


@pytest.mark.parametrize("size,percent,sample,rare", [(4, 85, 8, 4), (5, 80, 1, 2), (4, 50, 1, 1)])
def test_jaccard(docs, rows, monkeypatch, size, percent, sample, rare):
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "TOGETHER", 5)
    got = jaccard.grouped(docs, size, percent, sample).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components(rows, size, percent)
    assert len(got) == len(rows) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_parities():
    rng = np.random.default_rng(9)
    for n, own in ((0, 1), (3, 0), (60, 12), (900, 300)):
        x, y, z = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (n, own, own // 2))
        a, b = (jaccard.parities(np.concatenate([x, part])).view(np.uint64) for part in (y, z))
        assert len(a) == jaccard.BITS // 64 and sum(int(v).bit_count() for v in a ^ b) <= len(y) + len(z)


def test_one_of_each(docs, rows, empty):
    kept = jaccard.one_of_each(docs)
    want = {c for _, _, c in brute_components(rows, 4, 85)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 1
    assert jaccard.one_of_each(empty).count() == 0


def test_decontamination(spark, docs, rows, empty):
    passage = max((x for x in re.findall(r".+", rows[40][1])), key=len)
    items = [(1, " ".join(words(passage)[35:60])), (2, None), (3, ""), (4, "one TWO"), (5, " ".join(words(rows[0][1])[10:60])), (6, "not there at all today friends"), (5, None)]
    got = decontaminate.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    runs = lambda t, k: {tuple(w[i : i + k]) for w in [words((t or "").lower())] for i in range(len(w) - k + 1)}
    own = {i: runs(s, min(5, len(words(s)))) for i, s in items if words(s)}
    want = {(d, i) for d, t, *_ in rows if d is not None for i, s in own.items() if len(runs(t, len(next(iter(s)))) & s) * 100 >= 80 * len(s)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and len({i for _, i in want}) == 3
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    left = [d for d, t, *_ in rows if not any(len(runs(t, len(next(iter(s)))) & s) * 100 >= 80 * len(s) for s in own.values())]
    assert kept.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, left)) and None not in left
    assert decontaminate.contained(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contained(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_substring(docs, rows, empty, monkeypatch):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
    want = []
    for d, t, *_ in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    for bound, chunk in ((1 << 26, 1 << 22), (0, 1 << 22), (0, 3000), (0, 1)):
        monkeypatch.setattr(substring, "BROADCAST_BYTES", bound)
        assert sorted(map(repr, map(tuple, substring.cleaned(docs, chunk=chunk).collect()))) == sorted(map(repr, want))
    assert substring.cleaned(empty).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "assistant", "a<\\|b<\\\\|im_end|><|"), (1, 1, None, None), (2, 0, "assistant", ""), (2, None, "assistant", "é😀"),
             (3, 5, "sys\ntem<|nl|>", "x"), (3, 5, "sys\ntem<|nl|>", "x"), (None, 1, "user", "y"), (4, 1, "assistant", "z" * 100_000)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parsed", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted(table)).collect()}
    assert len(got) == 5 and all(r["ok"] for r in got.values()) and not got[4]["escaped"] and got[1]["escaped"]
    for conv, r in got.items():
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.formatted(table.limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
    }
    return sorted((m.start(), k, list(kinds)[k], m.end()) for k, (p, good) in enumerate(kinds.values()) for m in re.finditer(p, text or "") if good(m[0]))


def test_pii(spark):
    texts = ["é a.b@c.d.e%x@y.zz, a@b a@b.c.", "1.2.3.4.5.6.7.8 999.1.1.1 0012.3.4.5", "4111 1111-1111 1111 and 4111111111111112 5500000000000004", "+1 (017) 555-7713 +1+2 +49 30 1234567890123456", None, "", "7" * 40_000,
             "mail a@b.co ip 10.0.0.1 tel +1 (222) 555-0000 no 4111111111111111", "x@y.z" * 50, "😀 1.1.1.1", "a" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[7])]
    rows += [(100 + i, f"tel +1 ({i:03d}) 555-{i:04d} mail u{i}@m{i}.org ip 10.0.{i}.1 no 41111111111{i:05d} call 0{i:03d} 555 {i:04d}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    model = pii.fit(docs)
    assert len(model.trees) == pii.TREES
    done = pii.redactions(docs, model)
    got = done.select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()
    by_text = dict(rows)
    for r in got:
        want = ",".join(f"{k}:{a}:{z}" for a, _, k, z in brute_pii(by_text[r["doc_id"]]))
        assert r["b"] == want and set(filter(None, want.split(","))) <= set(r["s"].split(","))
    assert len(got) == len(rows)
    shown = {r["doc_id"]: r["redacted"] for r in pii.redact(docs, model).collect()}
    assert shown[7] == "mail [email] ip [ip] tel [phone] no [card]" and shown[4] == ""
    assert pii.redactions(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_pii_beyond_the_base_rules(spark):
    rows = [(i, f"as ereou {i % 7}a nti +1 ({i:03d}) 555-{i * 7919 % 10000:04d} hend u{i}.k@m{i}.org, ouan {1 + i % 200}.{i % 99}.{i % 250}.121 er 41111111111{i:05d} tin") for i in range(300)]
    new = [(900, "ereou (017) 555-7713 hend"), (901, "ouan hein.4(at)mail5(dot)org tin"), (902, "ouan hein.4 (at) mail5 (dot) org. Then on"),
           (903, "ereou 2024-05-17 nti"), (904, "ereou 12.345.678 nti"), (905, "ereou 83920184 nti"), (906, "ouan (at) 12.50 nti")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    texts = dict(new)
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] for r in pii.redactions(spark.createDataFrame(new, docs.schema), model).collect()}
    assert got == {900: ["(017) 555-7713"], 901: ["hein.4(at)mail5(dot)org"], 902: ["hein.4 (at) mail5 (dot) org"], 903: [], 904: [], 905: [], 906: []}


def test_trees_as_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (900, len(pii.FEATURES))).astype(float)
    y = (x[:, 1] + (x[:, 4] > 2) > 3).astype(float)
    model = pii.boost(x, y)
    table = spark.createDataFrame([(row.tolist(),) for row in x[:50]], "x array<double>")
    got = np.array([r[0] for r in table.select(model.log_odds(F.col("x"))).collect()])
    want = sum(pii.apply(t, x) for t in model.trees)
    assert np.allclose(got, want[:50]) and ((want > 0) == (y > 0)).mean() > 0.95


def test_toxicity(spark, empty):
    rng = np.random.default_rng(2)
    plain, bad = [f"p{i}" for i in range(60)], ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(260):
        own = list(rng.choice(plain, int(rng.integers(5, 120))))
        if i % 4 == 0:
            for j in rng.integers(0, len(own), 3):
                own[j] = str(rng.choice(bad)) + ","
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "  "), (None, "idiot"), (903, "p1 " * 9_000 + "moron"), (903, "p1 " * 9_000 + "moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.train(docs.filter("doc_id < 200 OR doc_id >= 900"), table.filter("doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    held = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(200, 260)]
    assert np.mean(held) > 0.9 and got[900] == got[901] == got[902] == 0 and got[903] >= 0.5
    assert toxicity.score(empty, net).count() == 0 and toxicity.train(docs, table.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_toxicity_windows_and_gradient():
    texts = [" ".join(f"a{i}" for i in range(n)).encode() for n in (0, 1, 24, 25, 36, 37, 100)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])
    t = toxicity.Text(Words(data, bounds), np.zeros(0, np.uint64))
    assert np.diff(t.bounds).tolist() == [0, 1, 1, 2, 2, 3, 8] and set(t.index[t.real]) == set(range(len(t.row)))
    net = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in toxicity.new_net(np.zeros(0, np.uint64)).items()}
    picks, y = np.array([0, 2, 5]), np.array([1.0, 0, 1])

    def loss(n):
        p = toxicity.logistic(toxicity.logits(n, t)[picks].astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = toxicity.gradient(net, t, picks, y, np.ones(3))
    for k, g in grad.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = {**net, k: net[k].copy()}, {**net, k: net[k].copy()}
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=2e-4), k


def test_language(spark, empty):
    rng = np.random.default_rng(4)
    sounds = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ö", "ei"], "cc": ["ção", "lh", "ê", "os"]}
    rows = []
    for i in range(240):
        lang = sorted(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang], 2)) for _ in range(int(rng.integers(4, 60)))), lang))
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "12 34 !", "cc"), (303, "the", None), (None, "schung", "bb"), (304, "The WHOU thing! " * 3_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, prototypes = language.train(docs.filter("doc_id % 4 != 2"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, names, prototypes).collect()}
    assert names == ["aa", "bb", "cc"] and np.mean([got[i][0] == rows[i][2] for i in range(2, 240, 4)]) == 1
    assert got[300] == got[301] == got[302] == ("und", 0.0) and got[304][0] == "aa" and 0 < got[304][1] <= 1
    assert language.predict(empty, names, prototypes).count() == 0 and language.train(docs.limit(0))[0] == []
    v = language.vectors(["abab ab"], language.Space())[0]
    letter = {c: language.signs(np.array([ord(c)]))[0] for c in " ab"}
    want = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(" abab ab ", "abab ab ", "bab ab "))
    assert np.allclose(v, want / np.linalg.norm(want), atol=1e-5)


def test_held_out_rule():
    assert zlib.crc32(b"7") % 5 in range(5)
