"""The training-data operators against brute force, and on null, empty, long, tied, repeated and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from quarrylens.llm import ann, chunks, packing, pu, quality, queries, repeats, reshard, simhash, urllists, wfst
from quarrylens.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, block int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts():
    rng = random.Random(3)
    shared = sentence(rng, 30)
    long = sentence(rng, 60_000)
    near = sentence(rng, 300)
    rows = [(0, sentence(rng, 50)), (1, shared + " " + sentence(rng, 20)), (2, "x " + shared + " é " + sentence(rng, 5)), (3, None), (4, ""), (5, "   \n\t "), (6, long), (7, long[1000:5000]), (8, near), (9, near + " tail"), (10, near)]
    rows += [(11, "short"), (12, "short"), (13, "a" * 400), (14, "a" * 120), (14, "a" * 120), (None, shared), (None, None), (15, "Ünïcode " * 30), (16, "Zß日本 " + "Ünïcode " * 20), (17, "A B c"), (18, "a b C")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "k", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_min_cost_flow_moves_least():
    flow = reshard.min_cost_flow([10, 0, 5], [4, 6, 5], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert flow == [{0: 4, 1: 6}, {}, {2: 5}]
    flow = reshard.min_cost_flow([3, 3], [3, 3], [[5, 1], [1, 1]])
    assert flow == [{1: 3}, {0: 3}]
    with pytest.raises(ValueError):
        reshard.min_cost_flow([3], [2], [[0]])


def test_reshard(spark, docs, none, tmp_path):
    rows = reshard.reshard_documents(docs, F.lit(0), 1, 3).collect()
    assert len(rows) == len(texts())
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in texts())
    assert reshard.reshard_documents(none, F.lit(0), 1, 3).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    placed = reshard.reshard_documents(many, F.when(F.col("doc_id") % 3 > 0, 0).otherwise(F.col("doc_id") % 5), 5, 8).cache()
    sizes = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 500
    moved = placed.where("old <> shard").agg(F.sum("size")).first()[0]
    old = {r["old"]: r["b"] for r in placed.groupBy("old").agg(F.sum("size").alias("b")).collect()}
    assert moved <= sum(max(0, b - sum(sizes) / 8) for b in old.values()) + 1000


def test_sparse_network_has_the_cost_of_the_dense_one():
    import random
    import time

    r = random.Random(2)
    for _ in range(60):
        n, m = r.randrange(1, 9), r.randrange(1, 9)
        supply = [r.choice((0, r.randrange(50))) for _ in range(n)]
        capacity = [r.randrange(20) for _ in range(m)]
        capacity[r.randrange(m)] += sum(supply)
        cost = lambda flow: sum(f for i, x in enumerate(flow) for j, f in x.items() if i != j)
        flow = reshard.stay_or_move(supply, capacity)
        assert [sum(x.values()) for x in flow] == supply and sum(map(len, flow)) <= 2 * (n + m)
        assert all(sum(x.get(j, 0) for x in flow) <= c for j, c in enumerate(capacity))
        assert cost(flow) == cost(reshard.min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)]))
    began = time.perf_counter()
    assert len(reshard.stay_or_move([10] * 100_000, [8] * 125_000)) == 100_000 and time.perf_counter() - began < 5
    with pytest.raises(ValueError):
        reshard.stay_or_move([3], [2])


def test_flow_decides_the_transfers(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = {}
    solve, fix = reshard.stay_or_move, reshard.correct

    def solved(supply, capacity):
        seen["flow"] = solve(supply, capacity)
        seen["supply"] = sum(supply)
        return seen["flow"]

    monkeypatch.setattr(reshard, "stay_or_move", solved)
    monkeypatch.setattr(reshard, "correct", lambda *a: seen.setdefault("moves", fix(*a)))
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(32))
    rows = reshard.reshard_documents(docs, old).toPandas()
    assert seen["supply"] == rows["size"].sum() and seen["moves"] < 0.05 * len(rows)
    cost = sum(n for i, out in enumerate(seen["flow"]) for j, n in out.items() if i != j)
    moved = rows.loc[rows["old"] != rows["shard"], "size"].sum()
    assert abs(moved - cost) <= 0.01 * cost
    allowed = {(i, j) for i, out in enumerate(seen["flow"]) for j in out}
    assert len(set(zip(rows["old"], rows["shard"], strict=True)) - allowed) <= seen["moves"]
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() < 0.05 * sizes.mean()


def test_very_large_rows_leave_the_others_even():
    flow = reshard.min_cost_flow([1000, 200], [400, 400, 400], [[0, 1, 1], [1, 0, 1]])
    large = [(0, 700, 0), (1, 100, 0), (2, 100, 0), (3, 100, 0), (4, 100, 1), (5, 100, 1)]
    at, room = reshard.place_large(large, flow)
    held = [0, 0, 0]
    for uid, size, _ in large:
        held[at[uid]] += size
    reshard.correct(at, large, held, 1)
    assert sorted(held) == [200, 300, 700]


def test_rewritten_shards_hold_every_row(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, f"text {i % 3}", f"s{i % 2}" if i % 4 else None, i, "x") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n int, shard_name string").repartition(3).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(4))
    placed = reshard.reshard_documents(docs, old, 4, 5, keep=reshard.FILE_ROW).cache()
    touched = reshard.rewrite_affected(docs, placed, str(tmp_path / "out")).toPandas()["shard"].tolist()
    written = spark.read.parquet(str(tmp_path / "out"))
    sizes = {r["shard"]: r["count"] for r in placed.where(F.col("shard").isin(touched)).groupBy("shard").count().collect()}
    assert {r["shard"]: r["count"] for r in written.groupBy("shard").count().collect()} == sizes
    assert set(touched) == {x for r in placed.where("old <> shard").collect() for x in (r["old"], r["shard"])}
    assert written.select("n").distinct().count() == written.count() == sum(sizes.values())
    assert written.where("doc_id is null").count() > 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, keep_ids=True, longest=1024).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0 for r in rows)
    of = {}
    for r in rows:
        of.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(of[i, len(ids)], key=lambda r: r["start"])
        if i is not None and i != 14:
            assert [x for p in pieces for x in p["ids"]] == ids
            assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)
    assert packing.pack(none, path).count() == 0


def test_unit_encoder_is_the_tokenizer():
    encoder = packing.UnitEncoder(queries.tokenizer_path())
    odd = ["İstanbul İİ ΑΣ Σ", "a\x1cb", "don't we'll x'S o'clock", "foo<|endoftext|>bar <|startoftext|>", "é Å", "x_y__ 3.14% ¾ ²x", "", "한국어 하", "the,,, the&&& 'tis it's. A B C"]
    assert encoder.encode(odd) == encoder._encode(odd)


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    met = np.zeros(len(x), bool)
    for a, b in zip(simhash._keys(x), simhash._keys(y), strict=True):
        met |= (a[:, :1] == b).any(axis=1)
    assert met.all()


def test_near_duplicates(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = {i: brute.simhash(t) for i, t in texts() if i is not None}
    groups = brute.components(prints)
    assert len(got) == len(texts())
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == groups[r["doc_id"]]
        else:
            assert r["component_id"] is None
    assert groups[10] == 8 and groups[9] == 8 and groups[18] == 17
    assert simhash.near_duplicates(none).count() == 0


def test_keys_are_not_broadcast(spark):
    """There are up to 56 keys a node, however small the table of nodes looks; a broadcast goes through the driver."""
    plan = simhash.links(spark.range(10).select(F.col("id").alias("fp"), F.col("id").alias("node")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)] + [(159, 50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in [50, *range(100, 160)]} == {50}


def test_repeats(docs, none):
    got = repeats.remove_repeats(docs)
    rows = got.collect()
    mine = sorted((brute.LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert mine == sorted(brute.repeats(texts()))
    assert [r["block"] for r in rows] == [1] * len(rows) and set(got.columns) >= {"lang", "kept"}
    assert repeats.remove_repeats(none).count() == 0


def test_longest_previous_factors():
    rng = random.Random(1)
    for turn in range(200):
        length = rng.choice([28, 30, 50])
        base = bytes(rng.choice(b"ab\0") for _ in range(200))
        parts, doc = [], []
        for _ in range(rng.randint(1, 12)):
            n = rng.randint(length, length + 30)
            at = rng.randint(0, 200 - n)
            part = bytearray(base[at : at + n])
            if rng.random() < 0.4:
                part[rng.randrange(n)] = rng.choice(b"abc")
            parts.append(bytes(part) if turn % 10 else b"a" * (length + 5))
            doc.append(rng.randint(0, 5))
        count = np.array([len(x) - length + 1 for x in parts])
        begin = np.cumsum([0] + [len(x) for x in parts])[:-1]
        data = b"".join(parts)
        frag, offset, longest = repeats.previous_factors(data, begin, count, np.array(doc), length)
        suffixes = [(parts[f][o:], doc[f]) for f, o in zip(frag, offset, strict=True)]
        assert longest.tolist() == brute.factors(suffixes, length)
        order, common = repeats.suffix_order(data, begin[frag] + offset, np.array([len(x) for x, _ in suffixes]))
        ordered = [suffixes[i][0] for i in order]
        assert ordered == sorted(ordered)
        assert all(n == brute.factors([(y, 1), (x, 0)], 0)[0] for x, y, n in zip(ordered, ordered[1:], common[1:], strict=False))


def test_repeats_with_hot_keys_and_many_blocks(docs):
    found = repeats.remove_repeats(docs.select("doc_id", "text"), block_bytes=20_000, key_bucket_bytes=50_000, bucket_bytes=20_000, hot_blocks=1)
    mine = sorted((brute.LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect())
    assert mine == sorted(brute.repeats(texts()))


def test_sentencepiece(docs, none):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = wfst.encode(docs, path)
    by = {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()}
    assert by == {(i, tuple(sp.encode(t or ""))) for i, t in texts()}
    back = {(r["doc_id"], r["text"]) for r in wfst.decode(encoded, path).collect()}
    assert back == {(i, t or "") for i, t in texts()}
    assert all(r["same"] for r in wfst.round_trip(docs, path).collect())
    assert wfst.encode(none, path).count() == 0
    m = wfst.Transducer(path)
    for text in ("  two  spaces ", "▁▁x", "\U0001f600 é\n\t", " " * 37, "in the beginning"):
        ids = np.frombuffer(m.encode(text), "<u4").tolist()
        assert ids == sp.encode(text) and m.decode(m.encode(text)) == sp.decode(ids)


def test_pair_acceptor_leaves_what_merges_yield():
    m = wfst.Transducer(queries.tokenizer_path("piece_bpe_32k.model"))
    score = {p: -w for p, (_, w) in m.piece.items()}
    rng = random.Random(2)
    common = [p for p in m.piece if p.isascii()]
    for _ in range(300):
        text = "".join(rng.choice(common) for _ in range(rng.randint(1, 6)))
        text = text if rng.random() < 0.7 else "".join(rng.choice("aabcx\u4e2d\U0001f600'") for _ in range(12))
        assert m.shortest_path(text) == brute.merges(text, score)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model(tmp_path, spark, docs, fallback):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = fallback
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True

    def add(piece, score, kind):
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, kind

    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(name, 0, kind)
    if fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, 6)
    rng = random.Random(5)
    known = {"\u2581", *"abcdefgh"} | {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(300)}
    known |= {"\u2581" + p for p in sorted(known)[:60] if "\u2581" not in p}
    for p in sorted(known):
        add(p, -rng.randint(4, 40) / 4 - len(p) / 8, 1)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), wfst.Transducer(path)

    def weight(ids):
        return sum(model.pieces[i].score if model.pieces[i].type == 1 else -m.unknown_weight * (model.pieces[i].type == 2) for i in ids)

    for _ in range(400):
        text = "".join(rng.choice("abcdefgh xy\u00e9") for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(m.encode(text), "<u4").tolist()
        other = sp.encode(text)
        assert ids == other or (weight(ids) == weight(other) and m.decode(m.encode(text)) == sp.decode(other)), text
    got = {(r["doc_id"], len(r["ids"])) for r in wfst.encode(docs, path).collect()}
    assert len(got) <= len(texts()) and (3, 0) in got


def test_quality_rules(spark, docs, none):
    got = quality.judge(docs, ["doc_id", "text", "kept"]).drop("kept").collect()
    assert len(got) == len(texts())
    for r in got:
        expected = brute.base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
    assert quality.judge(none, ["doc_id"]).count() == 0
    clean = "the cat of the house and a dog in that field was to be seen as it is for you on this day by all with care from here or there at once and they are so"
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(clean.split(), k=60)) + f" number {i}.") for i in range(50)] + [(99, " ".join(w.upper() + "!!" for w in clean.split() + clean.split()[::-1]))]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, rows), ["doc_id"]).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_unknown_languages_are_judged_by_the_nearest_reference(spark):
    rng = random.Random(7)
    clean = {"en": "the house of a dog and this field was to be seen as it is for you", "de": "der Hund und die Katze in den Feldern von einem Haus mit der Tür ist nicht hier"}
    text = lambda lang, n: " ".join(rng.choices(clean[lang].split(), k=80)) + f" {n}."
    rows = [(n, text(lang, n), lang) for n, lang in enumerate(["en", "de"] * 30)]
    shout = " ".join("#" + w.upper() + "!!" for w in rng.choices(clean["en"].split(), k=80))
    rows += [(100, text("de", 0), None), (101, text("en", 0), "xx"), (102, shout, None), (103, shout, "xx"), (104, shout, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df, ["doc_id"]).collect()}
    assert [got[i]["kept"] for i in range(100, 105)] == [True, True, False, False, False]
    assert all(got[i]["word_distance"] is None for i in (100, 101, 102, 103)) and got[104]["word_distance"] is not None
    # The distance is that to the nearest reference: not over the one to the text's own language.
    same = spark.createDataFrame([(r[0], r[1], None if r[0] == 0 else r[2]) for r in rows[:60]], df.schema)
    free = {r["doc_id"]: r["class_distance"] for r in quality.judge(same, ["doc_id"]).collect()}
    own = {r["doc_id"]: r["class_distance"] for r in quality.judge(df.where("doc_id < 60"), ["doc_id"]).collect()}
    assert free[0] <= own[0] + 0.02


def test_js_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [0.5, 0.5])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    assert np.allclose(got, [0.0, 1.0, np.sqrt(0.5 * np.log2(4 / 3) + 0.25 * np.log2(2 / 3) + 0.25)])


def test_pu_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = pu.score(docs, labels, ["doc_id"]).collect()
    assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in texts() if i}
    assert {r["score"] for r in pu.score(docs, labels.where("false"), ["doc_id"]).collect()} == {0.5}
    tied = pu.score(docs, labels, ["doc_id", "text", "kept"]).collect()
    by = {}
    for r in tied:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(x) == 1 for x in by.values()) and {r["kept"] for r in tied} == {"k"}
    assert pu.score(none, labels, ["doc_id"]).count() == 0


def test_pu_sums_are_those_of_the_risk(spark):
    """Risk, gradient and curvature of one step against their definitions, by finite differences."""
    rng = np.random.default_rng(3)
    x, p = rng.normal(size=(200, 2)), rng.random(200) < 0.3
    table = spark.createDataFrame([(v.tolist(), bool(t)) for v, t in zip(x, p, strict=True)], "x array<double>, trusted boolean").repartition(3)
    mean, std, w = x.mean(axis=0), x.std(axis=0), rng.normal(size=5)
    a = pu._sums(table, mean, std, w)
    z = pu._design(x, mean, std)

    def loss(v):
        return np.log1p(np.exp(-v))

    def total(v):
        return loss(-(z @ v)).sum()

    assert np.allclose([a[0], a[1]], [200, total(w)])
    step = 1e-5 * np.eye(5)
    slope = [(total(w + e) - total(w - e)) / 2e-5 for e in step]
    assert np.allclose(a[2:7], slope, rtol=1e-4)
    half = [[(total(w + e + f) - total(w + e - f) - total(w - e + f) + total(w - e - f)) / 4e-10 for f in step] for e in step]
    assert np.allclose(a[7:32].reshape(5, 5), half, rtol=1e-2, atol=1e-2)
    n, soft, g = a[32:35]
    assert n == p.sum() and np.isclose(soft - g, loss(z[p] @ w).sum())
    assert np.allclose(a[40:], z[p].sum(axis=0))


def test_pu_fit_lowers_the_non_negative_risk(spark):
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.7
    x = rng.normal(size=(600, 2)) + np.where(y, 1.5, -1.5)[:, None]
    trusted = y & (rng.random(600) < 0.4)
    table = spark.createDataFrame([(i, v.tolist(), bool(t)) for i, (v, t) in enumerate(zip(x, trusted, strict=True))], "_id long, x array<double>, trusted boolean")
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = pu._design(x, mean, std)

    def risk(w, prior):
        g = z @ w
        loss = lambda v: np.logaddexp(0, -v)
        return prior * loss(g[trusted]).mean() + max(0.0, loss(-g).mean() - prior * loss(-g[trusted]).mean()) + 0.5 * pu.RIDGE * (w[1:] ** 2).sum()

    prior = pu.estimate_prior(table, mean, std)
    assert abs(prior - y.mean()) < 0.12
    w = pu.fit(table.select("x", "trusted"), mean, std, prior)
    start = np.r_[np.log(prior / (1 - prior)), np.zeros(4)]
    assert risk(w, prior) < 0.7 * risk(start, prior)
    assert all(risk(w, prior) <= risk(w + 0.5 * rng.normal(size=5), prior) + 1e-3 for _ in range(50))
    assert ((z @ w > 0) == y).mean() > 0.95


def test_prior_of_bins():
    rng = np.random.default_rng(1)
    pos, neg = rng.beta(8, 2, 30_000), rng.beta(2, 8, 10_000)
    hist = lambda v: np.histogram(v, 512, (0, 1))[0].astype(float)
    assert abs(pu.best_bin(hist(np.r_[pos, neg]), hist(rng.beta(8, 2, 3000))) - 0.75) < 0.04


def test_pu_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op7_pu_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.9


def test_chunks(spark, docs, none):
    data = sentence(random.Random(5), 2000).encode()
    bounds, moved = chunks.cut([data, b"inserted " + data])
    assert bounds[0] == 0 and bounds[-1] == len(data) and max(np.diff(bounds)) <= chunks.MAX_BYTES and min(np.diff(bounds[:-1])) >= chunks.MIN_BYTES
    assert len(set(bounds) & {b - 9 for b in moved}) > 0.95 * len(bounds)
    assert chunks.cut([b"", b"ab"]) == [[0], [0, 2]]
    rows = chunks.dedup_chunks(docs).collect()
    assert len(rows) == len(texts())
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["n_removed"] == by[10]["n_bytes"] and by[10]["first_doc_ids"] == [8] and by[8]["n_removed"] == 0
    assert by[2]["n_removed"] > 60 and 1 in by[2]["first_doc_ids"] and by[0]["n_removed"] == 0
    assert by[7]["n_removed"] > 3500 and by[3]["n_chunks"] == 0
    seen, lost = set(), {}
    of = {}
    for i, t in texts():
        found = brute.gear_chunks((t or "").encode(), chunks._GEAR.tolist(), chunks.MIN_BYTES, chunks.MAX_BYTES, chunks.MASK_BITS)
        of.setdefault(brute.LAST if i is None else i, []).append(found)
    for i in sorted(of):
        # Rows with equal ids both keep what is first in either.
        first = {}
        for found in of[i]:
            for k, c in enumerate(found):
                first[c] = min(first.get(c, k), k)
        lost[i] = sorted(sum(len(c) for k, c in enumerate(found) if c in seen or first[c] != k) for found in of[i])
        seen |= set(first)
    removed = {}
    for r in rows:
        removed.setdefault(brute.LAST if r["doc_id"] is None else r["doc_id"], []).append(r["n_removed"])
    assert {i: sorted(n) for i, n in removed.items()} == lost
    assert chunks.dedup_chunks(none).count() == 0


def test_hilbert_curve_has_unit_steps():
    for d, bits in ((2, 3), (3, 2)):
        cells = np.indices((1 << bits,) * d).reshape(d, -1).T
        path = cells[np.argsort(ann.hilbert_keys(cells, bits))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 16))
    vectors[100:150] = vectors[7]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [1e30] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, window_share=1.0).collect()
    ids = np.array([*range(400), 505])
    m = np.array([r[1] for r in rows[:400]] + [[float(np.float32(1e30))] * 16])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in [*range(0, 400, 50)]:
        s = m @ m[q]
        s[q] = -9
        best = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))][:5]]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [x[1] for x in mine] == best and np.allclose([x[2] for x in mine], sorted(s, reverse=True)[:5])
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    m, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = queries.op9_hilbert_ann(spark, d).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = m @ m[q]
        s[q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[got.query_id == ids[q]].vec_id))
    assert hits >= 0.9 * len(got)


def test_url_lists(spark):
    day = lambda s: f"2024-{s}"
    entries = [("domain", "bad.org", day("01-10"), "add"), ("domain", "bad.org", day("03-01"), "remove"), ("domain", "bad.org", day("03-01"), "add"), ("host", "h.net", day("02-01"), "add"), ("url", "http://x.com/a", day("01-01"), "add"), ("url", None, day("01-01"), "add")]
    entries = spark.createDataFrame(entries, "kind string, pattern string, day string, action string").withColumn("day", F.to_date("day"))
    captures = [(1, "http://www.BAD.org/x", day("01-09")), (2, "http://www.bad.org/x", day("01-10")), (3, "https://u@bad.org:8080/", day("02-29")), (4, "http://bad.org", day("03-01")), (5, "http://h.net/", day("12-31")), (6, "http://a.h.net/", day("12-31")), (7, "http://x.com/a#f", day("01-01")), (8, None, day("02-01")), (9, "http://notbad.org/", day("02-01")), (3, "https://u@bad.org:8080/", day("02-29")), (10, "http://bad.org", None)]
    captures = spark.createDataFrame(captures, "page_id long, url string, day string").withColumn("day", F.to_date("day"))
    got = sorted((r["page_id"], r["blocked"], r["kinds"]) for r in urllists.apply_lists(captures, entries).collect())
    assert got == [(1, False, ""), (2, True, "domain"), (3, True, "domain"), (3, True, "domain"), (4, False, ""), (5, True, "host"), (6, False, ""), (7, True, "url"), (8, False, ""), (9, False, ""), (10, False, "")]
    odd = spark.createDataFrame([(1, "http://./x"), (2, "http://" + "a." * 5000 + "bad.org/" + "x" * 100_000), (3, "no address"), (4, "http://BAD.org./")], "page_id long, url string")
    odd = odd.select("*", F.lit("2024-02-01").cast("date").alias("day"), F.lit(1).alias("n_active"), F.lit("k").alias("kind"), F.lit("p").alias("pattern"))
    assert sorted((r["page_id"], r["host"] is None, r["blocked"]) for r in urllists.apply_lists(odd, entries).collect()) == [(1, True, False), (2, False, True), (3, True, False), (4, False, True)]
    assert urllists.apply_lists(captures.where("false"), entries).count() == 0
    assert urllists.apply_lists(captures, entries.where("false")).where("blocked").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_native_queries_match_sql(spark, name):
    from oracle import compare, duck

    d = "/root/testdata/sf0.001"
    assert compare(spark, duck(d), queries.QUERIES[name], queries.SQL[name], d) == ""


def test_accepted_documents_are_those_judged_good(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    good = {r[0] for r in quality.judge(docs, ["doc_id"]).where("kept").select("doc_id").collect()}
    assert {r["doc_id"] for r in quality.accepted(docs).collect()} == good
    good = {r[0] for r in pu.score(docs, labels, ["doc_id"]).where("predicted = 1").select("doc_id").collect()}
    found = pu.accepted(docs, labels)
    assert {r["doc_id"] for r in found.collect()} == good and found.columns == docs.columns
