"""Operators against the library, brute force, SQL and held-out rows; nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import bpe, chat, components, exact, lm, packing, quality, queries, rules, simhash, suffix, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, ids string, a string, place string"
WORDS = " ".join(f"w{i}" for i in range(70))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Hi  <|endoftext|> ÉÀß Σς é"), (5, WORDS), (5, WORDS), (6, WORDS + " tail"), (None, WORDS), (7, "a " * 300), (8, "x" * 30000), (9, "ok"), (10, "ok"), (11, "word " * 9000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "u", "i", "a", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    own = bpe.encoder(PATH)
    rng = random.Random(4)
    parts = ["Σ", "İ", "ß", "é", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<", "|>", "'S", "'ll", "1", "½", "中文", "\x00", "</w>", "w>", "a", "B", "th", "ing", " ", "\n", "😀", ".", "the,", "aaaaaaaa"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
    got = sorted(map(tuple, bpe.digest_documents(odd, PATH).collect()), key=repr)
    want = []
    for i, t in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digest_documents(none, PATH).count() == 0
    encoded = bpe.encode_documents(odd, PATH)
    assert sorted(r.text for r in bpe.decode_ids(encoded, PATH).collect()) == sorted(r.decoded for r in encoded.collect())


def test_cuts_are_certain():
    own = bpe.encoder(PATH)
    for piece in ("thequickzqx", "a", "aé"):
        assert "".join(own.fragments(piece)) == piece + bpe.END
    assert any(len(own.fragments(a + b)) == 2 for a in "qzxj" for b in "qzxj")


def pack_check(rows, docs, limits):
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= limits.tokens and len(own) <= limits.segments
    for key, ids in docs.items():
        own = sorted(by_doc.pop(key), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert not by_doc
    return [sum(r.length for r in own) for own in sequences.values()]


def test_packing(spark, none):
    own = bpe.encoder(PATH)
    rows = [(i, t) for i, t in enumerate([None, "", "hi", WORDS, "a " * 5000, "x " * 2047, *["short text"] * 40])]
    docs = {i: np.frombuffer(own.encode((t or "").encode()) + b"\1\0\0\0", "<u4") for i, t in rows}
    for limits in (packing.Limits(), packing.Limits(64, 4, 50)):
        sizes = pack_check(packing.pack_documents(frame(spark, rows), PATH, limits=limits, pool_size=16).collect(), docs, limits)
        assert all(n == limits.tokens or n & (n - 1) == 0 for n in sizes)
    assert packing.pack_documents(none, PATH).count() == 0


def test_short_texts_are_not_padded(spark):
    """Segments run out long before tokens do: 256 texts of three ids are 768 ids, so sequences of 512 are made."""
    rows = [(i, "of it") for i in range(2000)]
    docs = {i: np.frombuffer(bpe.encoder(PATH).encode(b"of it") + b"\1\0\0\0", "<u4") for i, _ in rows}
    sizes = pack_check(packing.pack_documents(frame(spark, rows), PATH).collect(), docs, packing.Limits())
    assert all(n & (n - 1) == 0 for n in sizes) and max(sizes) == 512


def test_packing_of_conversations(spark):
    """What op7 formats, packed under limits of which the loss binds; loss tokens are those of the replies and their ends."""
    turns = [(c, t, ("user", "assistant")[t % 2], " ".join(f"w{c}" for _ in range(c % 7 + 3 * t))) for c in range(40) for t in range(1 + c % 4)]
    found = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    limits, own = packing.Limits(128, 16, 24), bpe.encoder(PATH)
    rows = packing.pack_examples(found, PATH, limits=limits, pool_size=16).collect()
    sequences, by_example = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        by_example.setdefault((r.conv_id, r.example), []).append(r)
    for own_rows in sequences.values():
        held = sum(r.length for r in own_rows)
        assert held <= 128 and held & (held - 1) == 0 and len(own_rows) <= 16 and sum(r.loss_tokens for r in own_rows) <= 24
    assert max(sum(r.loss_tokens for r in x) for x in sequences.values()) == 24
    for e in found.collect():
        parts = [np.frombuffer(own.encode(x.encode()), "<u4") for x in (e.formatted[: e.loss_begin], e.formatted[e.loss_begin : e.loss_end], e.formatted[e.loss_end :])]
        ids = np.concatenate([*parts, np.array([1], "<u4")])
        pieces = sorted(by_example.pop((e.conv_id, e.example)), key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))] and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
        assert sum(r.loss_tokens for r in pieces) == len(parts[1]) + (e.loss_end > e.loss_begin)
    assert not by_example
    odd_rows = spark.createDataFrame([(1, 0, None, None, None), (None, 1, "a b", 0, 3), (None, 1, "a b", 0, 3)], found.schema)
    assert packing.pack_examples(odd_rows, PATH).filter("start = 0").count() == 3 and packing.pack_examples(odd_rows.limit(0), PATH).count() == 0


def test_packer_keeps_all_three_limits():
    rng, limits = random.Random(2), packing.Limits(100, 5, 40)
    packer = packing.VectorPacker(limits, 32, cuttable=False)
    pieces = []
    for i in range(300):
        n = rng.randint(1, 60)
        mask = np.array([rng.random() < 0.5 for _ in range(n)])
        mask[np.cumsum(mask) > 40] = False
        pieces.append(packing.Piece(i, 0, np.zeros(n, "<u4"), np.r_[0, np.cumsum(mask)], n))
    made = [*packer.add(pieces), *packer.finish()]
    assert sorted(p.key for _, own in made for p in own) == list(range(300))
    assert all(sum(len(p.ids) for p in own) <= 100 and len(own) <= 5 and sum(p.cost() for p in own) <= 40 for _, own in made)
    with pytest.raises(ValueError):
        list(packing.VectorPacker(limits, cuttable=False).add([packing.Piece(1, 0, np.zeros(101, "<u4"))]))


def brute_passages(rows, least):
    """Repeated passages from all windows; rows of (id, text) in order."""
    where = {}
    for d, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), []).append((d, i))
    spans, cuts = {}, {}
    for spots in where.values():
        if len(spots) > 1:
            for d, i in spots:
                spans.setdefault(d, set()).update(range(i, i + least))
            for d, i in sorted(spots)[1:]:
                cuts.setdefault(d, set()).update(range(i, i + least))
    out = []
    for d, places in spans.items():
        begin = None
        for i in sorted(places):
            if i - 1 not in places:
                begin = i
            if i + 1 not in places:
                out.append((rows[d][0], begin, i + 1 - begin, sum(x in cuts.get(d, ()) for x in range(begin, i + 1))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_suffix_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    shared = [" ".join(rng.choice("abcde") for _ in range(rng.randint(5, 14))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*shared, "x y", "z", "a a a a a a a a"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, suffix.repeated_passages(frame(spark, rows), 8, 3).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_passages(rows, 8)


@pytest.mark.parametrize("block", [4, 40])
def test_suffix_groups_that_no_task_sees_whole(spark, monkeypatch, block):
    """One passage in all rows, with unlike words around it: its suffixes lie in many tasks and blocks, and matches of unlike length cross."""
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = random.Random(block)
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, " ".join([*(rng.choice("uvw") for _ in range(rng.randint(0, 9))), passage, *(rng.choice("xyz") for _ in range(rng.randint(0, 9)))])) for i in range(90)]
    assert sorted(map(tuple, suffix.repeated_passages(frame(spark, rows), 12, 4).collect()), key=repr) == brute_passages(rows, 12)


def test_suffix_on_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.begin, r.n_words) for r in suffix.repeated_passages(odd).collect()}
    assert {(5, 0, 70), (6, 0, 70), (None, 0, 70), (7, 0, 300), (11, 0, 9000)} == got
    kept = suffix.deduplicate(odd).collect()
    assert set(odd.columns) == set(kept[0].asDict())
    assert sum(WORDS in (r.text or "") for r in kept) == 1 and {1, 2, 3, 4, 8, 9, 10} <= {r.doc_id for r in kept}
    clean = frame(spark, [(i, t) for i, t in ODD if i in (1, 2, 3, 4, 8, 9, 10)])
    assert sorted(map(tuple, suffix.deduplicate(clean).collect()), key=repr) == sorted(map(tuple, clean.collect()), key=repr)
    assert suffix.repeated_passages(none).count() == 0 and suffix.deduplicate(none).count() == 0


def test_exact_dedup(spark, odd, none):
    rows = exact.decide(odd).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(t or "", []).append(i)
    for r in rows:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert Counter((r.text or "") for r in exact.deduplicate(odd).collect()) == Counter(groups.keys())
    assert exact.deduplicate(odd).columns == odd.columns
    assert exact.decide(none).count() == 0 and exact.deduplicate(none).count() == 0
    full = exact.decide(odd, max_cells=1).drop("uid")  # a filter far too small still gives right answers
    assert sorted(map(tuple, full.collect()), key=repr) == sorted(map(tuple, exact.decide(odd).drop("uid").collect()), key=repr)


def brute_print(text, size=3):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum((2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams)) << b for b in range(64)) if grams else 0


def brute_parts(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, odd, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    prints = [brute_print(t) for _, t in ODD]
    parts = brute_parts(prints, 2)
    least = {p: min((i for (i, _), q in zip(ODD, parts) if q == p and i is not None), default=None) for p in parts}
    assert got == {(i, f"{f:016x}", least[p]) for (i, _), f, p in zip(ODD, prints, parts)}
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*{x for x in least.values() if x is not None}, None])


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_ball_hashing_links_what_is_near(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(8)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r.node: r.root for r in components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)).collect()}
    want = brute_parts(prints, distance)
    groups, own = {}, {}
    for i, p in enumerate(want):
        groups.setdefault(p, set()).add(signed[i])
    for x in signed:
        own.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, None)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "a### b"), (1, 2, "assistant", "</turn>\n### x: y"), (1, 3, "user", None), (1, 4, "assistant", "\\#\\"), (1, 5, "user", "left"), (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 1, None, "t"), (4, 1, "ro:le#\\", "é" * 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        said = "".join(t for role, t in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert [e.example for e in sorted(chat.examples(df).filter("conv_id = 1").collect(), key=lambda e: e.example)] == [0, 1, 2]
    assert chat.examples(df.limit(0)).count() == 0 and chat.read_back(chat.examples(df.limit(0))).count() == 0
    for text in ("", "\\", "</turn>", "<\\/turn>", "###\\#", "a\\</turn>\n### b: c"):
        assert chat.unescape(chat.escape(text)) == text and "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert plain(df.select(*names).collect()) == plain(con.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({queries.oracle_sql()[name]})").fetchall())


def test_rules(spark, odd, none):
    con = duckdb.connect()
    con.register("documents", odd.toPandas())
    want = con.sql(rules.oracle())
    assert plain(rules.judge(odd).select(*want.columns).collect()) == plain(want.fetchall())
    assert rules.judge(none).count() == 0
    python = [n for n in ("Python", "Pandas", "Arrow", "Exchange") if n in rules.judge(odd)._jdf.queryExecution().executedPlan().toString()]
    assert python == []


def auc(score, label):
    """The share of pairs in the right order, ties counting half."""
    ones = np.array([s for s, y in zip(score, label) if y])[:, None]
    zeros = np.array([s for s, y in zip(score, label) if not y])[None, :]
    return float((ones > zeros).mean() + (ones == zeros).mean() / 2)


@pytest.mark.parametrize("module, target, least", [(toxicity, "toxic", 0.8), (quality, "quality", 0.95)])
def test_classifiers_hold_on_unseen_rows(spark, odd, none, module, target, least):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = {r.doc_id: r for r in module.score_documents(spark.read.parquet(f"{big}/documents.parquet"), labels).collect()}
    own = [(rows[r.doc_id].score, r[target]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert auc([s for s, _ in own], [y for _, y in own]) > least
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in rows.values())
    found = module.score_documents(odd, labels).collect()
    assert len(found) == len(ODD) and all(r.score is not None for r in found)
    assert module.score_documents(none, labels).count() == 0
    assert module.score_documents(odd, labels.limit(0)).count() == len(ODD)


def test_factorisation_machine_equals_all_pairs():
    rng = np.random.default_rng(4)
    model = toxicity.FactorisationMachine(np.arange(12, dtype=np.int32), rng.normal(0, 0.3, (13, toxicity.FACTORS + 1)).astype(np.float32))
    model.params[-1, 1:] = 0
    rows = [np.sort(rng.choice(12, n, replace=False)).astype(np.int32) for n in (0, 1, 5, 12, 0, 3)]
    for row, got in zip(rows, model.score(rows)):
        z = float(model.params[-1, 0]) + sum(float(model.params[i, 0]) for i in row)
        z += sum(float(model.params[i, 1:] @ model.params[j, 1:]) for n, i in enumerate(row) for j in row[n + 1 :])
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert len(model.score([])) == 0


def test_pairs_that_single_weights_miss(spark):
    """Each of two insults is aimed at one group and banter in the other: no word tells anything alone, any sum of weights is at chance."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1600):
        insult, group = rng.randrange(2), rng.randrange(2)
        said = [f"f{rng.randrange(400)}" for _ in range(20)] + [("bleep", "blorp")[insult], ("martians", "venusians")[group]]
        rng.shuffle(said)
        rows.append((i, " ".join(said)))
        labels.append((i, int(insult == group)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(frame(spark, rows), known).collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert auc([found[i].score for i in held], [labels[i][1] for i in held]) > 0.99
    model = toxicity.train(frame(spark, rows), known)
    find = toxicity.Terms(model.slots)
    learned = [i for i in found if i not in held]
    linear = np.zeros((len(rows), len(model.slots) + 1))
    for i, text in rows:
        linear[i, find(text.encode())] = linear[i, -1] = 1
    y = np.array([y for _, y in labels], float)
    weights = np.linalg.lstsq(linear[learned].T @ linear[learned] + np.eye(linear.shape[1]), linear[learned].T @ y[learned], rcond=None)[0]
    assert auc((linear[held] @ weights).tolist(), y[held].tolist()) < 0.6


def test_terms_that_tell_only_in_pairs_are_admitted(spark):
    """Term 2 is in one of twenty rows of either label, and decides among the rows with term 1."""
    rows = [(1, [1, 2])] * 100 + [(1, [3])] * 1900 + [(0, [1])] * 700 + [(0, [2])] * 100 + [(0, [4])] * 1200
    table = spark.createDataFrame(rows, "label int, terms array<int>")
    alone = spark.range(1).select(toxicity.gain(F.lit(100.0), F.lit(200.0), F.lit(2000.0), F.lit(4000.0))).first()[0]
    assert alone == pytest.approx(0, abs=1e-9)
    assert 2 in toxicity.admitted(table).tolist()
    assert toxicity.admitted(table.limit(0)).tolist() == []


def test_word_vectors_equal_a_count_of_neighbours(spark, odd):
    texts = ["b a b c", "", "a", "c c a", WORDS]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
    places, signs = quality.index_vectors()
    want = np.zeros((quality.WORDS + quality.SHAPES, quality.DIMS))
    for text in texts:
        for s, ids in enumerate(quality.Streams()(text.encode())):
            for i, a in enumerate(ids.tolist()):
                for b in [b for j, b in enumerate(ids.tolist()) if 0 < abs(i - j) <= quality.REACH]:
                    want[a + s * quality.WORDS, places[b + s * quality.WORDS]] += signs[b + s * quality.WORDS]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)
    pooled = quality.pool(want.astype(np.float32), quality.Streams()(b"a c"))
    own = quality.Streams()(b"a c")[0]
    assert np.allclose(pooled[: quality.DIMS], want[own].mean(axis=0), atol=1e-6) and pooled[-1] == pytest.approx(math.log(3) / 4)
    assert not quality.pool(want.astype(np.float32), quality.Streams()(None)).any()


def test_temperature_and_range():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 6, 4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-logits / 3))).astype(float)
    assert quality.fitted_temperature(logits, labels) == pytest.approx(3, rel=0.15)
    assert quality.fitted_temperature(np.empty(0), np.empty(0)) == pytest.approx(1)
    x = rng.normal(0, 1, (400, 5))
    net = quality.fit(x, (x[:, 0] > 0).astype(float))
    far, edge = x[:1] + 1000, np.maximum(x[:1], x.max(axis=0))
    assert net.probabilities(far) == pytest.approx(net.probabilities(edge))  # beyond the training rows nothing is extrapolated
    assert auc(net.probabilities(x).tolist(), (x[:, 0] > 0).tolist()) > 0.95


def test_without_labels(spark, odd):
    """Nothing is called toxic, and nothing is rejected."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_documents(odd, labels).collect()} == {0}
    assert {r.predicted for r in quality.score_documents(odd, labels).collect()} == {1}
    assert quality.keep_good(odd, labels).count() == len(ODD)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    for module in (toxicity, quality):
        assert plain(module.score_documents(docs, labels).collect()) == plain(module.score_documents(docs, other).collect())


SMALL = lm.Shape(own=24, shared=8, dims=8, head=64, batch=256)


def test_lm(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in lm.score_documents(docs, SMALL).collect()}
    texts = {r.doc_id: [*words(r.text.lower() if r.text.isascii() else r.text.encode().lower().decode()), b"\n"] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    total, types = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in counts for w in t), total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    found = lm.score_documents(odd, SMALL).collect()
    assert len(found) == len(ODD) and all(math.isfinite(r.score) for r in found)
    assert lm.score_documents(none, SMALL).count() == 0


def test_lm_score_equals_brute_force(spark):
    """Every token by its own softmax over all leaves and its share of the leaf, from counts made here; and all words' probabilities add up to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).coalesce(1)
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[: SMALL.own]
    own = sorted(frequent if b"\n" in frequent else [*frequent[:-1], b"\n"])  # the end always has a leaf of its own
    leaf = lambda w: own.index(w) if w in own else SMALL.own + xxhash.xxh32_intdigest(w.rstrip(b".,;:!?")[-2:]) % SMALL.shared
    tokens, types = np.zeros(SMALL.leaves), np.zeros(SMALL.leaves)
    for w, c in counts.items():
        tokens[leaf(w)] += c
        types[leaf(w)] += 1
    learned = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).select("text")
    head = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: SMALL.own])
    model = lm.train(learned, lm.Vocabulary(head, SMALL), (tokens + 0.1) / (tokens + 0.1).sum())
    far, near, target, bias = (x.astype(float) for x in model.parts())

    def probabilities(a, b):
        scores = (far[a] + near[b]) @ target.T + bias
        return np.exp(scores) / np.exp(scores).sum()

    def share(w):
        k = leaf(w)
        return 1.0 if k < SMALL.own else (counts[w] + 0.1) / (tokens[k] + 0.1 * (types[k] + 1))

    for r in lm.score_documents(docs, SMALL).collect():
        ids = [leaf(b"\n")] * 2 + [leaf(w) for w in texts[r.doc_id]]
        want = sum(math.log10(probabilities(*ids[i : i + 2])[ids[i + 2]] * share(w)) for i, w in enumerate(texts[r.doc_id]))
        assert r.score == pytest.approx(want, rel=1e-4)
    all_words = sum(probabilities(0, 3)[leaf(w)] * share(w) for w in counts)
    unseen = sum(probabilities(0, 3)[k] * 0.1 / (tokens[k] + 0.1 * (types[k] + 1)) for k in range(SMALL.own, SMALL.leaves))
    assert all_words + unseen == pytest.approx(1, abs=1e-9)


def test_lm_learns_from_context():
    """Most tokens follow from the last or the last but one; noise-contrastive steps find that, which no unigram can."""
    rng = np.random.default_rng(2)
    shape = lm.Shape(own=6, shared=2, dims=16, batch=256)
    ids = np.zeros(40_000, np.int16)
    ids[:2] = 0, 1
    for i in range(2, len(ids)):
        draw = rng.random()
        ids[i] = (ids[i - 1] + 1) % 8 if draw < 0.5 else (ids[i - 2] + 5) % 8 if draw < 0.9 else rng.integers(8)
    shares = np.full(8, 1 / 8)
    learner = lm.Learner(lm.beginning(shares, shape), shares, shape, 1)
    for _ in range(4):
        for at in range(0, len(ids) - 2, shape.batch):
            learner.step(ids[at : at + shape.batch][: len(ids) - 2 - at], ids[at + 1 : at + 1 + shape.batch][: len(ids) - 2 - at], ids[at + 2 : at + 2 + shape.batch])
    of_far, of_near, normaliser = lm.LogBilinear(learner.mean).look_ups()
    f, n, w = ids[:-2].astype(int), ids[1:-1].astype(int), ids[2:].astype(int)
    assert (of_far[f, w] + of_near[n, w] - normaliser[f, n]).mean() > math.log(1 / 8) + 0.5


@pytest.mark.parametrize("cosine", [False, True])
def test_similar_texts_equal_brute_force(spark, odd, none, cosine):
    """One text of each group at five words and 0.8, against all pairs; planted copies with changed words."""
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"v{rng.randrange(3000)}" for _ in range(400)]
    for i in range(60):
        near = list(base)
        for at in rng.sample(range(400), i % 12):
            near[at] = "changed"
        rows.append((100_000 + i, " ".join(near)))
    rows += [(200_000 + i, t) for i, (_, t) in enumerate(ODD)]
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            union, both = len(sets[a] | sets[b]), len(sets[a] & sets[b])
            if not union or both and both >= 0.8 * (math.sqrt(len(sets[a]) * len(sets[b])) if cosine else union) - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = simhash.deduplicate_similar(frame(spark, rows), cosine=cosine)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in ids if find(i) == i]
    assert simhash.deduplicate_similar(none).count() == 0
    assert simhash.deduplicate_similar(odd).count() == 7  # a null and a repeated id: of the empty, of the seventy words and of "ok" one each, and four alone


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert sorted(after.columns) == sorted(docs.columns), name
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in kept.collect()}
        kept = after
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert "pipeline" in entry.queries()


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    """Nulls, empty texts, repeated rows, clashing names and no rows at all, through each stage by itself."""
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, odd, SF)
        rows = after.collect()
        counts[name] = len(rows)
        if name != "packing":
            assert after.columns == odd.columns, name
            assert {r.doc_id for r in rows} <= {i for i, _ in ODD}
        if name in ("quality classifier", "exact dedup", "simhash near-dedup"):
            assert {(r.doc_id, r.text) for r in rows} <= set(ODD), name
        assert stage(spark, none, SF).collect() == [], name
    assert counts["exact dedup"] == len({t or "" for _, t in ODD})
    assert counts["simhash near-dedup"] == 7
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, odd, SF).collect()}
    assert {2, 10} <= kept and not {1, 9} & kept  # of equal texts the largest id stays, and null is empty


def test_very_long_texts(spark):
    """A text of two million characters, and a conversation with a reply of one million."""
    rng = random.Random(8)
    vocabulary = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(280_000))
    rows = [(1, long), (2, "short text"), (3, long + " tail")]
    docs = frame(spark, rows)
    tokens = {r.doc_id: r.n_tokens for r in bpe.digest_documents(docs, PATH).collect()}
    packed = packing.pack_documents(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: n + 1 for i, n in tokens.items()} and tokens[1] > 400_000
    assert {r.doc_id: r.n_words for r in rules.judge(docs).collect()} == {1: 280_000, 2: 2, 3: 280_001}
    assert [(r.doc_id, r.begin, r.n_words, r.n_cut) for r in sorted(suffix.repeated_passages(docs).collect())] == [(1, 0, 280_000, 0), (3, 0, 280_000, 280_000)]
    assert {r.doc_id: r.kept for r in exact.decide(docs).collect()} == {1: True, 2: True, 3: True}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert sorted(r.doc_id for r in simhash.deduplicate_similar(docs, cosine=True).collect()) == [1, 2]
    assert {r.doc_id: r.n_tokens for r in lm.score_documents(docs, SMALL).collect()} == {1: 280_001, 2: 3, 3: 280_002}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.score_documents(docs, labels).count() == quality.score_documents(docs, labels).count() == 3
    reply = "#\\</turn>" * 120_000
    said = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", reply), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.examples(said)).first()
    assert (found.n_turns, found.loss_chars, found.loss_sha256) == (3, len(reply), hashlib.sha256(reply.encode()).hexdigest())


def test_bounded_cache():
    from plumbline.llm.common import BoundedCache

    cache = BoundedCache(lambda k: k * 2, 10, 3)
    for i in range(1000):
        assert cache[str(i % 37)] == str(i % 37) * 2
    assert len(cache) <= 10 and len(cache.old) <= 10 and cache["longer"] == "longerlonger" and "longer" not in cache


def test_similar_texts_amid_boilerplate(spark):
    """Planted pairs at 0.85 whose words are mostly the ones that hundreds of unlike texts share too."""
    rng = random.Random(11)
    shared = [f"b{i}" for i in range(330)]
    rows, gone = [], []
    for i in range(300):
        own = [f"o{i}x{k}" for k in range(70)]
        rows.append((i, " ".join(shared + own)))
        if i >= 240:
            at = rng.randrange(43)
            rows.append((1000 + i, " ".join(shared + own[:at] + [f"c{i}x{k}" for k in range(27)] + own[at + 27 :])))
            gone.append(1000 + i)
    kept = {r.doc_id for r in simhash.deduplicate_similar(frame(spark, rows)).collect()}
    assert sorted(i for i, _ in rows if i not in kept) == gone


def test_similar_texts_with_a_repeated_line(spark):
    """How often a line is repeated changes no set of shingles, so neither the signature; pairs with one at 0.97 are found."""
    line = WORDS.encode() + b" "
    assert simhash.signature(line * 2)[0] == simhash.signature(line * 300)[0]
    assert (simhash.signature(line * 2)[1] == simhash.signature(line * 300)[1]).all()
    rows = []
    for i in range(60):
        text, own = " ".join(f"w{i}x{k}" for k in range(150)), " ".join(f"l{i}x{k}" for k in range(12))
        rows += [(i, f"{text} {own}"), (1000 + i, text + f" {own}" * 300)]
    assert sorted(r.doc_id for r in simhash.deduplicate_similar(frame(spark, rows)).collect()) == list(range(60))


def test_unlike_copies_of_one_text_are_not_paired(spark):
    """Of 160 copies with changed words, any two at about 0.6, hardly any pair is made, and those alike are found."""
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(300)], []
    for i in range(160):
        near = list(base)
        for at in rng.sample(range(300), 7):
            near[at] = f"c{i}x{at}"
        rows.append((i, " ".join(near)))
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(5)]
    texts = spark.createDataFrame([(i, i, t) for i, t in rows], "doc long, root long, text string")
    found = {(r.u, r.v) for r in simhash.overlaps(texts, 5, simhash.Bar()).collect()}
    assert len(found) < 100 and {(i, 1000 + i) for i in range(5)} <= found
    assert sorted(r.doc_id for r in simhash.deduplicate_similar(frame(spark, rows)).collect()) == list(range(160))


def test_sketches_are_a_bound_and_fold():
    rng = np.random.default_rng(2)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (300, 290, 200), (5000, 4000, 3500)):
        x = np.unique(rng.integers(0, 2**63, n + m - both, dtype=np.uint64))
        a, b = x[:n], x[n - both :]
        for longs in (simhash.SKETCH, simhash.FOLDED):
            differing = sum(map(int.bit_count, (simhash.sketch(a, longs) ^ simhash.sketch(b, longs)).view(np.uint64).tolist()))
            assert differing <= n + m - 2 * both and differing % 2 == (n + m) % 2
        assert (np.bitwise_xor.reduce(simhash.sketch(a).reshape(-1, simhash.FOLDED)) == simhash.sketch(a, simhash.FOLDED)).all()


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_in_one_task_and_in_rounds(spark, small):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, None)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.root for r in components.connected_components(df, small=small).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.connected_components(df.limit(0), small=small).count() == 0


@pytest.mark.parametrize("whole", [3, 10**6])
def test_suffix_groups_whole_or_spread(spark, monkeypatch, whole):
    """Only groups over the bound are spread and settled by their windows."""
    monkeypatch.setattr(suffix, "WHOLE", whole)
    rng = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(9)) for k in range(5)]
    rows = [(i, " ".join([*(rng.choice("uvw") for _ in range(rng.randint(0, 9))), rng.choice(passages), *(rng.choice("xyz") for _ in range(rng.randint(0, 9)))])) for i in range(90)]
    rest, extend = [], suffix.extend

    def spied(*args):
        settled, others = extend(*args)
        rest.append(others.count())
        return settled, others

    monkeypatch.setattr(suffix, "extend", spied)
    assert sorted(map(tuple, suffix.repeated_passages(frame(spark, rows), 12, 4).collect()), key=repr) == brute_passages(rows, 12)
    assert (rest[0] > 0) == (whole == 3)


def test_suffixes_of_one_document_make_one_row_a_block(spark, monkeypatch):
    """A line that a document repeats has many suffixes of one key; what is found of them is a list."""
    line = " ".join(f"l{i}" for i in range(12))
    rows = [(i, " ".join([f"h{i}", *[line] * 40])) for i in range(6)]
    made, extend = [], suffix.extend

    def spied(*args):
        settled, others = extend(*args)
        made.append((settled.count(), settled.select(F.sum(F.size("places"))).first()[0]))
        return settled, others

    monkeypatch.setattr(suffix, "extend", spied)
    assert sorted(map(tuple, suffix.repeated_passages(frame(spark, rows), 12, 4).collect()), key=repr) == brute_passages(rows, 12)
    assert made[0][1] > 5 * made[0][0]


def test_rows_are_split_by_ids(spark):
    """No row whose id is there goes with the others, and of these few stay open."""
    from plumbline.llm.common import split_by_ids

    rows = spark.createDataFrame([(i * 7 - 900, f"t{i}") for i in range(3000)] + [(None, "none")], "doc long, text string")
    ids = spark.createDataFrame([(i * 21 - 900,) for i in range(100)], "doc long")
    perhaps, others = split_by_ids(rows, "doc", ids)
    there = {r.doc for r in ids.collect()}
    open_rows = [r.doc for r in perhaps.collect()]
    assert perhaps.columns == others.columns == rows.columns and there <= set(open_rows) and len(open_rows) < 600
    assert sorted([r.text for r in perhaps.collect()] + [r.text for r in others.collect()]) == sorted(r.text for r in rows.collect())
    assert split_by_ids(rows, "doc", ids.limit(0))[0].count() == 0
    assert {r.doc for r in split_by_ids(rows, "doc", ids, most=1 << 15)[0].collect()} >= there


def test_texts_outside_repeats_are_not_shuffled(spark, monkeypatch):
    """Only texts with a repeated passage meet their places, and few others."""
    joined, split = [], suffix.split_by_ids
    monkeypatch.setattr(suffix, "split_by_ids", lambda *a: joined.append([x.count() for x in split(*a)]) or split(*a))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(400)] + [(1000 + i, f"{passage} e{i}") for i in range(3)]
    kept = {r.doc_id: r.text for r in suffix.deduplicate(frame(spark, rows)).collect()}
    assert kept == dict(rows[:401]) | {1001: " e1", 1002: " e2"}
    assert [x[0] + x[1] for x in joined] == [403, 403] and joined[0][0] < 60 and joined[1][0] < 60


def test_sizes_rule_out_pairs(spark):
    """Texts that meet but whose sizes are too far apart aren't compared by their sketches."""
    seen = []
    bar = simhash.Bar()
    pairs = spark.createDataFrame([(100, 80), (100, 79), (80, 100), (0, 0), (1, 0)], "n long, m long")
    for r in pairs.select("n", "m", bar.possible(None, F.col("n"), None, F.col("m"), 0).alias("may")).collect():
        seen.append((r.n, r.m, r.may))
    assert seen == [(100, 80, True), (100, 79, False), (80, 100, True), (0, 0, True), (1, 0, False)]
