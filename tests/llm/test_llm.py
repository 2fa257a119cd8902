"""The training-data operators against brute force, on small tables with awkward rows."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, licenses, mixing, neardup, packing, quality, token_counts, token_files, topk, toxicity
from docloom.llm.license_rules import BASE, GATES, rules
from docloom.llm.queries import vocabulary
from docloom.llm.tokens import Encoder

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
#: Names that clash with the operators' own.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, node string, _id string, taken string"
ODD = [None, "", " ", "a", "a  b\n c", "x" * 9000, "it's <|endoftext|> THE", "ΣΑΣ é ½² 日本語 テキスト", "a\x1cb", "\n\n\n", "l'été, où?!"]


def table(spark, texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", s, len(t or ""), "r", "s", "n", "i", "t") for i, t, s in zip(ids, texts, sources or itertools.cycle(["s1", "s2", None]))]
    return spark.createDataFrame(rows, CLASH)


def words(n, seed, pool=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def corpus():
    base = words(120, 1)
    near = [" ".join(w if random.Random(k * 1000 + i).random() > 0.02 else "zz" for i, w in enumerate(base.split())) for k in range(12)]
    return [*ODD, base, base, base.replace(" ", "  "), base.upper(), *near, *(words(80, s) for s in range(20, 40)), words(4000, 3)]


# --- tokens -------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    e = Encoder(path)
    for text in filter(None, corpus()):
        assert e.encode(text) == e._library(text) == e.encode(text)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(WORD), corpus()
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, texts), WORD).collect()}
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 2048)
    assert token_counts.count_tokens(table(spark, [None]).limit(0), WORD).count() == 0
    piece = vocabulary("piece_bpe_32k.model")
    assert token_counts.count_tokens(table(spark, ["hello world"]), piece).first()["n_tokens"] > 0


def test_whole_tokens_are_single():
    proved = token_counts.whole_tokens(WORD)
    e = Encoder(WORD)
    assert len(proved) > 10_000 and all(len(e._library(w)) == 4 for w in sorted(proved)[:500])


def check_packing(rows, lengths):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for d, n in lengths.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == n
            at += r["length"]
        assert at == n
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    return padding


def test_packing(spark):
    texts = corpus()
    e = Encoder(WORD)
    ids = {i: e.encode(t or "") + (2).to_bytes(4, "little") for i, t in enumerate(texts)}
    rows = packing.pack_documents(table(spark, texts), WORD).collect()
    padding = check_packing(rows, {i: len(b) // 4 for i, b in ids.items()})
    assert padding <= 0.1 * sum(len(b) // 4 for b in ids.values())
    assert len({r["item"] for r in rows}) == len(texts)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in rows)
    assert packing.pack_documents(table(spark, [None]).limit(0), WORD).count() == 0


def test_differencing():
    r = random.Random(0)
    lengths = [r.randrange(1, 1500) for _ in range(200)]
    found = packing.difference(lengths, 16)
    sums = [sum(lengths[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(200)) and max(sums) - min(sums) < 50


@pytest.mark.parametrize(("lengths", "least", "count"), [([3, 3, 3], 2, 2), ([5, 5, 5, 1], 2, 3), ([4] * 7, 4, 4), ([7, 6, 6, 2, 1], 3, 3), ([6] * 10, 8, 10), ([8] * 5, 5, 5), ([1], 1, 1)])
def test_window_count_rises(lengths, least, count):
    """Windows hold every length whole, so that 5, 5, 5 and 1 need three windows of 8 though two could hold their sum."""
    assert -(-sum(lengths) // 8) == least
    found = packing.balance(lengths, 8)
    assert len(found) == count and all(0 < sum(lengths[i] for i in w) <= 8 for w in found)
    assert sorted(i for w in found for i in w) == list(range(len(lengths)))


@pytest.mark.parametrize("lengths", [[600] * 500, [1] * 9000, [1000, 30, 999] * 200, [int(10 ** random.Random(k).uniform(0, 4)) for k in range(3000)], [1024], [], [1023, 1]])
def test_packer_keeps_every_token(lengths):
    packer, windows = packing.Packer(1024), []
    for i, n in enumerate(lengths):
        windows += packer.add(i, n)
    full = len(windows)
    windows += packer.end()
    sums = [sum(n for _, _, n in w) for w in windows]
    assert set(sums[:full]) <= {1024} and max(sums, default=0) <= 1024 and sum(n != 1024 and n & (n - 1) > 0 for n in sums) <= 1
    held = defaultdict(list)
    for w in windows:
        for i, start, n in w:
            held[i].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(held[i]):
            assert start == at and size > 0
            at += size
        assert at == n


def test_packing_repeated_and_null_ids(spark):
    rows = packing.pack_documents(table(spark, ["a b c", "a b c", "d", None], ids=[1, 1, None, 2]), WORD, with_ids=True).collect()
    by_item = defaultdict(list)
    for r in rows:
        by_item[r["item"]].append(r)
    e = Encoder(WORD)
    whole = sorted((v[0]["doc_id"] is None, v[0]["doc_id"] or 0, [x for r in sorted(v, key=lambda r: r["start"]) for x in r["ids"]]) for v in by_item.values())
    code = lambda t: [*np.frombuffer(e.encode(t), np.int32).tolist(), 2]
    assert whole == [(False, 1, code("a b c")), (False, 1, code("a b c")), (False, 2, [2]), (True, 0, code("d"))]


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack(data, bits, 1001) == ids).all()


def test_file_random_access(tmp_path):
    from pyarrow import fs

    docs = [(i if i else None, np.arange(i * 7 % 50, dtype="<u4")) for i in range(40)]
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "f")) as out:
        w = token_files.Writer(out, 15, 64)
        for d, ids in docs:
            w.add(d, ids.tobytes())
        w.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        reader = token_files.Reader(source)
        assert all((reader.document(k) == ids).all() for k, (_, ids) in enumerate(docs))
        assert [c[3] for c in reader.checksums()] == [zlib.crc32(ids.tobytes()) for _, ids in docs]


def test_token_files(spark):
    texts = corpus()
    e = Encoder(BYTE)
    rows = token_files.token_files(table(spark, texts), BYTE).collect()
    at = 0
    for r, (i, text) in zip(sorted(rows, key=lambda r: r["start"]), enumerate(texts), strict=True):
        ids = e.encode(text or "") + (2).to_bytes(4, "little")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_files.token_files(table(spark, [None]).limit(0), BYTE).count() == 0


# --- duplicates -----------------------------------------------------------------------------------


def test_exact_groups(spark):
    texts = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, n = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    for r in exact_dedup.exact_groups(table(spark, texts)).collect():
        t = norm[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (first[t], n[t], first[t] == r["doc_id"])
    assert exact_dedup.exact_groups(table(spark, [None]).limit(0)).count() == 0


def test_chunks_are_content_defined():
    r = random.Random(1)
    a = bytes(r.randrange(97, 123) for _ in range(40_000))
    chunks = lambda d: [d[i:j] for i, j in itertools.pairwise([0, *exact_dedup.cuts(d)])]
    assert b"".join(chunks(a)) == a and max(map(len, chunks(a))) <= exact_dedup.MOST
    assert len(set(chunks(a)) & set(chunks(b"inserted" + a))) >= len(chunks(a)) - 2


def test_drop_duplicates_with_repeated_ids(spark):
    docs = table(spark, ["a b", "a  b", "a b", "c", None, ""], ids=[1, 1, 1, None, None, 2])
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns and Counter(re.sub(" +", " ", r["text"] or "") for r in out.collect()) == Counter(["a b", "c", ""])


def components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    texts = corpus()
    sets, expected = components(texts, width, 80)
    rows = neardup.near_duplicates(table(spark, texts), width, 80).collect()
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["component_id"] for i in range(len(texts))] == expected
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    kept = neardup.drop_near_duplicates(table(spark, texts), width, 80)
    assert kept.count() == len(set(expected))


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(table(spark, [None]).limit(0)).count() == 0


def test_estimates():
    r = random.Random(3)
    common = [r.randrange(2**64) for _ in range(4000)]
    a, b = (neardup.registers(np.unique(np.array(common + [r.randrange(2**64) for _ in range(500)], np.uint64))) for _ in range(2))
    used = ((a != 0) | (b != 0)).sum()
    assert abs(neardup.corrected(((a == b) & (a != 0)).sum() / used) - 0.8) < 0.13 and used > 250


def chained(copies=60, length=90, seed=5):
    """Near copies of one text, many of them nearly at the threshold to each other, and chains between them."""
    r, base = random.Random(seed), words(length, 7).split()
    out = []
    for k in range(copies):
        text = list(r.choice(out).split() if out and k % 3 == 0 else base)
        for _ in range(r.randrange(6)):
            text[r.randrange(len(text))] = f"n{r.randrange(40)}"
        out.append(" ".join(text[: len(text) - r.randrange(8)]))
    return out


@pytest.mark.parametrize("whole", [1024, 70, 1])
def test_near_duplicates_in_large_buckets(spark, monkeypatch, whole):
    """Whole sets, some of them and none in the last join, buckets that are dealt over several parts, no stars."""
    texts = chained()
    for name, value in (("LARGE", 4), ("BLOCK", 16), ("WHOLE", whole), ("ROUNDS", 1), ("FAN", 8)):
        monkeypatch.setattr(neardup, name, value)
    _, expected = components(texts, 4, 80)
    assert 1 < len(set(expected)) < len(set(texts))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, texts), 4, 80).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_near_duplicates_repeated_and_null_ids(spark):
    base = words(60, 9)
    texts = [base, base, base + " more", words(60, 10), None, base]
    rows = neardup.near_duplicates(table(spark, texts, ids=[5, 5, 7, 5, 8, None]), 4, 80).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows) == [(False, 5, 5, True), (False, 5, 5, True), (False, 5, 5, True), (False, 7, 5, False), (False, 8, 8, True), (True, 0, 5, False)]


def test_near_duplicates_of_the_documents(spark):
    """All links of a whole table, by an index of all shingles."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no table")
    docs = spark.read.parquet(path)
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sets, held = {}, defaultdict(list)
    for i, text in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
        for s in sets[i]:
            held[s].append(i)
    common = Counter(p for ids in held.values() for p in itertools.combinations(ids, 2))
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert got == {i: (find(i), len(sets[i])) for i in rows}


# --- search, models, licences, mixing -------------------------------------------------------------


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=8)], "c") for i in range(300)] + [(301, None, "c"), (302, [1.0, None], "c"), (303, [float("nan")], "c"), (304, [float("inf")], "c"), (None, [1.0], "c"), (305, [], "c")]
    rows += [(i, rows[5][1], "c") for i in range(310, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    usable = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in usable}
    expected = set()
    for q in (i for i in ints if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)[:10]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in topk.exact_top_k(df).collect()} == expected
    assert topk.exact_top_k(df.limit(0)).count() == 0


def labelled(spark):
    good = [". ".join(words(12, s).capitalize() for s in range(k, k + 5)) for k in range(300)]
    bad = [" | ".join(words(3, s).upper() + "!!" for s in range(k, k + 9)) for k in range(300)]
    toxic = [f"{words(20, k)} moron {words(9, k + 1)} l0ser stуpid {words(9, k)}" for k in range(300)]
    texts = good + bad + toxic
    y = [(i, int(i < 300 or i >= 600), int(i >= 600)) for i in range(len(texts))]
    return table(spark, [*texts, None, ""]), spark.createDataFrame([*y, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality.classify_quality(docs, labels).collect()
    assert len(rows) == 902 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] < 300) for r in held]) > 0.97
    none = quality.classify_quality(docs, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}


def test_quality_equals_plain_densities():
    """The cached factors give the log densities that the inverse and the determinant of the covariances give."""
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(0, 1, (60, 5)), r.normal(1, 2, (40, 5))])
    y = np.array([0] * 60 + [1] * 40)
    model = quality.fit_discriminant(x, y, {0: 60, 1: 40})
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / 98
    density = []
    for c in (0, 1):
        z = x[y == c]
        cov = (1 - quality.POOLED) * np.cov(z.T) + quality.POOLED * pooled
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * (np.trace(cov) / 5 + 1e-6) * np.eye(5)
        d = x - z.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), density[1] - density[0])


def test_classifiers_on_odd_tables(spark):
    docs, labels = labelled(spark)
    twice = docs.where("doc_id % 7 = 1").unionByName(docs.where("doc_id % 7 = 1"))
    model = quality.fit_quality(docs.unionByName(twice), labels.unionByName(labels))
    once = quality.fit_quality(docs, labels)
    assert np.allclose(model.means, once.means)
    lexicon = toxicity.fit_toxicity(docs.unionByName(twice), labels.unionByName(labels))
    assert lexicon.weights == toxicity.fit_toxicity(docs, labels).weights
    assert quality.score_quality(docs.limit(0), model).count() == 0 == toxicity.score_toxicity(docs.limit(0), lexicon).count()
    plain = toxicity.fit_toxicity(docs, labels.limit(0))
    assert set(plain.weights.values()) == {toxicity.SEED_WEIGHT} and toxicity.score_toxicity(docs, plain).count() == 902
    assert {r["n"] for r in toxicity.score_toxicity(twice, lexicon).groupBy("doc_id", "score").agg(F.count("*").alias("n")).collect()} == {2}


def test_lexicon_hits_equal_a_plain_scan():
    r = random.Random(8)
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idi": 1.5, " trash ": 2.0, " moron ": 1.0, " jerk ": 2.5})
    a = lexicon.automaton()
    pool = ["idiot", "idiotic", "idi", "Trash", "can", "moron", "m0ron", "jerk", "chicken", "knee", "the", "take", "out", "x", "idi0t!"]
    for _ in range(300):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(12)))
        folded = toxicity.fold(text)
        inside = [False] * len(folded)
        for phrase in lexicon.exceptions:
            for m in re.finditer(f"(?={re.escape(phrase)})", folded):
                inside[m.start() : m.start() + len(phrase) - 1] = [True] * (len(phrase) - 1)
        total = 0.0
        for start in range(len(folded)):
            found = [w for t, w in lexicon.weights.items() if folded.startswith(t, start)]
            total += max(found, default=0.0) * (not inside[start])
        assert toxicity.measure(text, a)[0] == pytest.approx(total), text


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_of_the_documents(spark, sf):
    """Held-out recall and false alarms on whole tables, with few labels and with more."""
    path = f"/root/testdata/{sf}"
    if not os.path.exists(path):
        pytest.skip("no table")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("held_out").collect()
    hits = Counter((y[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in y)
    assert hits[0, 1] <= 0.02 * (hits[0, 0] + hits[0, 1])
    # About a fiftieth of the labels are wrong: toxic documents without a single word of the lexicon.
    text, seeds = {r["doc_id"]: r["text"] for r in docs.collect()}, {toxicity.fold(w).strip() for w in toxicity.SEEDS}
    assert all(r["predicted"] == 1 for r in rows if y.get(r["doc_id"]) == 1 and seeds & set(toxicity.fold(text[r["doc_id"]] or "").split()))
    assert hits[1, 1] >= (0.85 if sf == "sf0.1" else 0.6) * (hits[1, 1] + hits[1, 0])


def test_test_licenses(spark):
    texts = [*ODD, "Licensed under the Apache License, Version 2.0.", "cc by nc cc by nc CC BY-NC 4.0", "Released under the MIT License; GNU General Public License, version 3", "SPDX-License-Identifier: BSD-3-Clause", "under the mit licenses", "All rights reserved. " * 50]
    rows = {r["doc_id"]: r for r in licenses.license_digest(table(spark, texts)).collect()}
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in enumerate(texts):
        w = cut.findall((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        places, labels = [], set()
        for phrase, label in BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels))), text
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    last = len(ODD)
    assert rows[last]["labels"] == "apache-2" and rows[last + 2]["labels"] == "gpl-3,mit" and rows[last + 3]["labels"] == "bsd-3" and rows[last + 4]["labels"] == ""


def test_rules_have_gates():
    assert len(rules()) > 300
    for r in rules():
        re.compile(r.regex)
        assert any(g in r.regex.replace("[cs]", "").replace("licene", "licen") or "licen[cs]e" in r.regex for g in GATES), r


def forms(pattern):
    """Texts of a rule's alternatives, each without its optional parts."""
    from re import _parser

    def made(op, a):
        if op is _parser.LITERAL:
            return [chr(a)]
        if op is _parser.IN:
            return [chr(a[0][1][0] if a[0][0] is _parser.RANGE else a[0][1])]
        if op is _parser.BRANCH:
            return [t for p in a[1] for t in joined(p)]
        if op is _parser.SUBPATTERN:
            return joined(a[3])
        if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            return ["".join(p) for p in itertools.product(joined(a[2]), repeat=a[0])]
        assert op in (_parser.ANY, _parser.ASSERT, _parser.ASSERT_NOT), op
        return ["q" if op is _parser.ANY else ""]

    def joined(parsed):
        return ["".join(p) for p in itertools.product(*[made(op, a) for op, a in parsed])]

    return joined(_parser.parse(pattern))


def test_gates_lose_no_form(spark):
    texts = sorted({re.sub(" +", " ", t).strip() for r in rules() for t in forms(r.regex)})
    assert {"bsd 3 clause", "zero clause bsd", "mit no attribution", "simplified licence", "shared under creative commons attribution"} <= set(texts)
    compiled = [(re.compile(r.regex), r) for r in rules()]
    rows = {r["doc_id"]: r["detections"] for r in licenses.scan_licenses(table(spark, texts)).select("doc_id", "detections").collect()}
    for i, text in enumerate(texts):
        kept = []
        for start, back, priority, label in sorted((m.start(), -m.end(), r.priority, r.label) for c, r in compiled for m in c.finditer(f" {text} ")):
            if not kept or start >= -kept[-1][1]:
                kept.append((start, back, priority, label))
            elif back < kept[-1][1] and priority < kept[-1][2]:
                kept[-1] = (start, back, priority, label)
        assert kept, text
        assert [(d["start"], d["end"], d["label"]) for d in rows[i]] == [(s, -b, label) for s, b, _, label in kept], text


def test_mixing(spark):
    texts = [words(30 + k % 50, k) for k in range(400)] + [None, ""]
    docs = table(spark, texts, sources=[["a", "a", "b", "c", None][k % 5] for k in range(402)])
    rows = mixing.mix(docs).collect()
    sizes = {i: len((t or "").split()) for i, t in enumerate(texts)}
    total, by = sum(sizes.values()), {}
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    for taken, target, size in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 0.01 * target + 5
    again = mixing.mix(docs).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns and made.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def plain_targets(sizes, weights, share, most):
    """Targets by sharing the budget, stopping what is full and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        rest = budget - sum(target[s] for s in order if s not in open_)
        part = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else part[s]
        open_ -= full or set(open_)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_plain_sharing(spark, seed):
    r = random.Random(seed)
    names = [None, "a", "B", "é", "\U0001f600", "z", "\ufffd", "ab"][: 2 + 2 * seed]
    sizes = {s: int(10 ** r.uniform(0, 4)) for s in names}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3.0, 1.0, 2.0), 1.5, 2.0).collect()
    expected = plain_targets(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert {x["source"]: pytest.approx(x["target"]) for x in rows} == expected


def test_mixing_repeated_and_null_ids(spark):
    docs = table(spark, ["a b", "a b", "c d e", "f", None], ids=[1, 1, None, None, 3], sources=["s"] * 5)
    rows = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == [(False, 1, 2), (False, 1, 2), (False, 3, 0), (True, 0, 1), (True, 0, 3)]
    assert all(r["taken"] <= 2 * r["size"] and r["target"] == 12.0 for r in rows)
    assert mixing.mixed_documents(docs).select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)


def test_mixing_draws_whole_documents(spark):
    texts = [words(1 + k * 7 % 90, k) + "  \n" for k in range(600)] + [None, ""]
    ids = [None if k % 50 == 0 else k % 500 for k in range(602)]
    docs = table(spark, texts, ids=ids, sources=[["a", "a", "b", "c", None][k % 5] for k in range(602)])
    rows = mixing.mix(docs, blocks=4).collect()
    by = {}
    for r in rows:
        assert all(d["words"] == r["size"] for d in r["draws"])
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert len(by) == 4 and all(abs(taken - target) <= 45 for taken, target in by.values())
    made = mixing.mixed_documents(docs, blocks=4).collect()
    assert set(made) <= set(docs.collect())
    assert Counter(r["doc_id"] for r in made) == Counter(r["doc_id"] for r in rows for _ in r["draws"])
    huge = table(spark, [words(100, 1), words(3, 2)], ids=[1, 2], sources=["a", "a"])
    assert {r["text"] for r in mixing.mixed_documents(huge, share=0.1, blocks=1).collect()} <= {r["text"] for r in huge.collect()}


def test_shard_quotas_are_exact(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 41), (None, 3)], "source string, quota long")
    rows = mixing.shard_quotas(quotas, 3, 1).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        per_source[r["source"]] += r["draws"]
        per_shard[r["shard"]] += r["draws"]
    assert per_source == {"a": 700, "b": 41, None: 3} and len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = read.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        columns = read.columns
        stage(spark, read, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        read = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert read.columns == columns and read.count() <= before
    assert read.where("doc_id between 300 and 599").count() < 10 < read.where("doc_id < 300").count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
