"""Operators against brute force, on small tables with nulls, empty and odd texts, repeats and clashing columns."""

import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from deltaloom.llm import blockcoder, brown, chat, compression, decontaminate, exchange, idfile, idstore, licenses, mixing, nearcopies, simhash, tokencount, tokens, warc

WORDS = "the of and quick brown fox jumps over lazy dog ontion edble thhan inre erst weak lamp river stone cloud glass field north winter".split()


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[k] + ("" if k % 3 else str(k)) for k in draw.integers(0, len(WORDS), n))


TEXTS = [None, "", " \n\t", "one", "é à ü  x\n\ny", "A<|endoftext|> b", prose(1, 80), prose(1, 80) + " end", prose(2, 300), prose(3, 60), prose(3, 60), "la " * 400, "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}" if k % 5 else None, "u", k) for k, t in enumerate(TEXTS)]
    rows += [(8, TEXTS[8], "s2", "u", 0), (None, TEXTS[6], "s0", "u", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, fp long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_simhash_components_equal_brute_force(docs, none):
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    expected = Counter((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group))
    found = simhash.fingerprint_results(simhash.near_duplicates(docs))
    assert Counter(map(tuple, found.collect())) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_by_definition():
    found = b"a b c d e".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[k : k + 4]), 42) for k in range(2)]
    assert simhash.fingerprint("A b\tC d E") == hashes[0] & hashes[1]
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_dense_groups_keep_every_link(spark):
    """Fingerprints around a centre and a chain of steps of four bits: all are one component, far ones are not."""
    draw = np.random.default_rng(5)
    values = {0}
    for _ in range(300):
        values.add(int(sum(1 << int(b) for b in set(draw.integers(0, 64, draw.integers(1, 5))))))
    chain = (1 << 64) - 1
    values |= {chain ^ sum(1 << b for b in range(4 * k)) for k in range(5)}
    values = sorted(values)
    from deltaloom.sources.scratch import Scratch

    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    linked = {r.node % (1 << 64): r.root for r in simhash.link_fingerprints(frame, Scratch(spark, "t")).collect()}
    group = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(values):
            for b, y in enumerate(values):
                if bin(x ^ y).count("1") <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    size = Counter(group)
    assert set(linked) == {v for v, g in zip(values, group) if size[g] > 1}
    assert len({(linked[v], g) for v, g in zip(values, group) if v in linked}) == len({linked[v] for v in linked}) == len({g for v, g in zip(values, group) if v in linked})


def test_near_copies_equal_brute_force(spark):
    """Copies with words replaced here and there, of similarity above and below the limit, and a dense group."""
    draw, texts = np.random.default_rng(8), ["", None, "one", "ONE", "two words"]
    for k in range(40):
        base = invented(9000 + k, 150).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6) if k else [1, 2, 3] * 20:
            copy = list(base)
            for at in draw.integers(0, len(copy), changes):
                copy[at] = f"new{draw.integers(1 << 30)}"
            texts.append(" ".join(copy).upper())

    def shingles(text):
        found = (text or "").lower().split()
        return {" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))}

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    far = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                far += bin(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).count("1") > 4
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert far > 100  # pairs beyond op1's distance
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = nearcopies.components(docs).collect()
    assert len(found) == len(texts) and len({(group[r.doc_id], r.root) for r in found}) == len(set(group)) == len({r.root for r in found})
    assert sorted(r.doc_id for r in nearcopies.keep_one_of_each(docs).collect()) == sorted(set(group))
    assert nearcopies.keep_one_of_each(docs.where("false")).count() == 0


def test_texts_that_are_somewhat_alike_are_not_paired_up(spark):
    """Copies of one text, each with changes of its own: all similar pairs come out of the join, and few others."""
    from deltaloom.sources.scratch import Scratch

    draw, base, texts = np.random.default_rng(3), invented(1, 150).split(), []
    for k in range(150):
        copy = list(base)
        for at in draw.integers(0, len(copy), 1 + k % 4):
            copy[at] = f"new{draw.integers(1 << 30)}"
        texts.append(" ".join(copy))
    plain = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, tie long, text string").repartition(4)
    copies, scratch = nearcopies.NearCopies(), Scratch(spark, "t")
    found = scratch.save(nearcopies.marks(plain, copies), "marks")
    sets = scratch.save(nearcopies.shingles_of(plain, found, found.select("node"), copies), "sets")
    pairs = nearcopies._prefix_pairs(found.select("node", F.col("node").alias("label")), sets, scratch, copies).collect()
    of = {r.node: set(r.shingles) for r in sets.collect()}
    nodes = sorted(of)
    similar = {(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b])}
    assert similar and similar <= {tuple(r) for r in pairs} and len(pairs) < len(similar) + 0.02 * len(nodes) ** 2 / 2


def repeat_words_slow(found):
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})


def test_quality(docs, none):
    for text in TEXTS:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, chars, symbols, lines, repeats = compression.base_counts(text)
        assert (n, chars, symbols) == (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")))
        seen = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert lines == len(seen) - len(set(seen)) and repeats == repeat_words_slow(found)
    found = {r.doc_id: r for r in compression.quality(docs).collect()}
    assert found[9].kept and not found[11].kept and found[11].base_failed and not found[12].kept and found[0].n_words == 0
    assert compression.keep_good(docs).columns == docs.columns and compression.keep_good(none).count() == 0


def test_bands_reject_what_the_base_passes():
    packer, bands = __import__("zstandard").ZstdCompressor(level=3), compression.Bands()
    draw = np.random.default_rng(1)
    noise = " ".join("".join(chr(c) for c in draw.integers(33, 127, 12)) for _ in range(400))
    *_, failed, ratio, _, kept = compression.judge(noise, bands, packer)
    assert not failed and not kept and ratio > 0.76
    assert compression.judge(prose(9, 400), bands, packer)[-1]


def littered(seed, n):
    """Invented words with bars and symbols between them, which pass the base."""
    draw = np.random.default_rng(seed)
    return " | ".join(f"{invented(seed * 1000 + k, 4)} ##" if draw.integers(2) else invented(seed * 1000 + k, 3) for k in range(n // 4))


def invented(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(3, 10))) for _ in range(n))


def test_bands_from_labels_reject_littered_texts(spark, tmp_path):
    import corpus_pipeline as pipeline

    good, junk = [invented(k, 600) for k in range(60)], [littered(k, 600) for k in range(500, 520)]
    rows = [(k, t) for k, t in enumerate(good + junk)] + [(0, good[0]), (None, good[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(r.kept for r in compression.quality(docs).collect())  # without labels the limits are wide
    marks = [(k, 1) for k in range(0, 60, 2)] + [(k, 0) for k in range(60, 80, 2)] + [(None, 1), (999, 1), (61, None)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = compression.labels_in(spark, str(tmp_path))
    bands = compression.fitted(docs, labels)
    assert bands == compression.fitted(docs.repartition(5), labels.repartition(3)) and compression.labels_in(spark, f"{tmp_path}/none") is None
    assert compression.fitted(docs, labels.where("false")).chunk == compression.Bands().chunk
    found = {r.doc_id: r for r in compression.quality(docs, bands).collect()}
    assert not any(found[k].kept or found[k].base_failed for k in range(60, 80))
    assert sum(found[k].kept for k in range(60)) >= 55
    kept = pipeline.quality(spark, docs, str(tmp_path)).collect()
    assert kept and all(r.doc_id is None or r.doc_id < 60 for r in kept)


def test_limits_come_from_all_good_texts(spark):
    """Every row labelled good counts, whatever their number, with each of its chunks."""
    import zstandard

    pool = invented(1, 20000).split()
    texts = [" ".join(pool[k : k + (60 + k % 40 if k % 100 else 8000)]) for k in range(4300)] + ["la " * 300]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[11])], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))], "doc_id long, quality int")
    bands, pack = compression.fitted(docs, labels), zstandard.ZstdCompressor(level=3).compress
    by_length, chunks = {}, []
    for data in (t.encode() for t in [*texts[:-1], texts[11]]):
        by_length.setdefault(max(s for s in (0, *bands.starts) if s <= len(data)), []).append(len(pack(data)) / len(data))
        chunks += [len(pack(data[k : k + 2048])) / 2048 for k in compression.chunk_starts(len(data), 2048)]
    assert len(chunks) > 16 * 43  # more than 16 in each long text
    for start, low, high in bands.whole:
        if len(by_length.get(start, [])) >= 20:
            a, b = np.quantile(by_length[start], [0.01, 0.995])
            assert (low, high) == pytest.approx((a, b * 1.05), rel=1e-12)
    a, b = np.quantile(chunks, [0.01, 0.995])
    assert bands.chunk == pytest.approx((a, b * 1.05), rel=1e-12)


def slow_verdict(text, bands):
    """Whole ratio, share of bad chunks and verdict, from the bytes."""
    import zstandard

    data, size = (text or "").encode(), bands.chunk_bytes
    pack = lambda x: len(zstandard.ZstdCompressor(level=bands.level).compress(x))
    chunks = [data[k : k + size] for k in range(0, len(data), size)]
    if len(data) < size:
        chunks = []
    elif len(chunks[-1]) < size:
        chunks[-1] = data[-size:]
    bad = [not bands.chunk[0] <= pack(c) / size <= bands.chunk[1] for c in chunks]
    share = sum(bad) / len(bad) if sum(bad) > 1 else 0.0
    ratio = pack(data) / len(data) if data else 1.0
    limits = [(low, high) for start, low, high in bands.whole if start <= len(data)]
    within = not limits or limits[-1][0] <= ratio <= limits[-1][1]
    found = (text or "").split()
    failed = len(found) < 50 or 100 * repeat_words_slow(found) > 50 * len(found)
    return ratio, share, failed, not failed and within and share <= bands.bad_share


def test_verdicts_against_brute_force(spark):
    """Chunks count up to the last byte, and one bad chunk alone does not."""
    draw = np.random.default_rng(11)
    noise = "".join(chr(c) for c in draw.integers(33, 127, 6000))
    flat = " ".join(f"same{k % 9}words here" for k in range(300))
    texts = [invented(k, n) for k, n in enumerate((10, 49, 50, 60, 200, 300, 700, 2000))] + [None, "", "x" * 2048, "ab " * 900]
    texts += [invented(20, 900) + " " + noise[:n] for n in (100, 1900, 4100, 6000)] + [invented(21, 900) + " " + flat, flat + " " + invented(22, 900), noise[:2047], " ".join([noise] * 2)]
    for bands in (compression.Bands(), compression.Bands(chunk=(0.3, 0.62), whole=((300, 0.35, 0.7), (3000, 0.4, 0.66)), bad_share=0.2)):
        found = {r.doc_id: r for r in compression.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands).collect()}
        for k, text in enumerate(texts):
            ratio, share, failed, kept = slow_verdict(text, bands)
            assert (found[k].ratio, found[k].bad_chunks, found[k].base_failed, found[k].kept) == (pytest.approx(ratio), pytest.approx(share), failed, kept), k
    assert any(r.bad_chunks > 0.2 for r in found.values()) and any(r.kept for r in found.values())


CLASHING = ["TEXT", "Doc_Id", "c0", "c1", "fp", "row", "word", "chunk", "judged", "clean", "SOURCE", "bucket", "place", "tie", "id", "no_id", "size", "x", "base", "blocks"]


def test_clashing_columns_odd_rows_and_long_texts_in_every_operator(spark):
    """Names that differ in case or are an operator's own change nothing; every row has its result, repeats included."""
    long = " ".join(invented(k, 5000) for k in range(10)) + " " + "z" * 300_000
    item = f"What is {prose(60, 20)}? It is {prose(61, 8)}."
    rows = [(k, t, f"s{k % 3}" if k % 4 else None) for k, t in enumerate([*TEXTS, long, item + " " + invented(3, 90), "Released under the MIT License " + invented(4, 70)])]
    rows += [rows[8], rows[8], (None, None, None), (None, long, "s1"), (8, invented(77, 90), "s2")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    types = ", ".join(f"`{name}` {'string' if k % 2 else 'int'}" for k, name in enumerate(CLASHING))
    extra = ["odd" if k % 2 else k for k in range(len(CLASHING))]
    odd = spark.createDataFrame([(*extra[:5], a, *extra[5:9], b, c, *extra[9:]) for a, b, c in rows], ", ".join([*types.split(", ")[:5], "doc_id long", *types.split(", ")[5:9], "text string, source string", *types.split(", ")[9:]])).repartition(3)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    each_row = {
        "simhash": simhash.near_duplicates,
        "quality": compression.quality,
        "mix": lambda d: mixing.Mixture(d, mixing.Mix(block_words=500, shard_words=2500)).taken(),
        "brown": lambda d: brown.score(d, brown.BrownModel(frequent=50, chunk_tokens=3000)).drop("score"),
        "ids": lambda d: idstore.store_and_read(d).drop("start"),
        "counts": tokencount.count_tokens,
        "licenses": licenses.scan,
    }
    rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    for name, operator in each_row.items():
        found = [Counter(map(rounded, operator(d).collect())) for d in (plain, odd)]
        assert found[0] == found[1] and sum(found[0].values()) == len(rows), name
    leaks = [Counter(map(tuple, decontaminate.find_leaks(d, items).collect())) for d in (plain, odd)]
    assert leaks[0] == leaks[1] and sum(leaks[0].values()) == 1
    keeping = {
        "keep_good": compression.keep_good,
        "keep_one_of_each": nearcopies.keep_one_of_each,
        "drop_contaminated": lambda d: decontaminate.drop_contaminated(d, items),
        "mix": lambda d: mixing.Mixture(d, mixing.Mix(block_words=500, shard_words=2500)).documents(),
    }
    for name, operator in keeping.items():
        kept = operator(odd)
        assert kept.columns == odd.columns, name
        at = [odd.columns.index(c) for c in ("doc_id", "text", "source")]
        assert Counter(tuple(r[k] for k in at) for r in kept.collect()) == Counter(map(tuple, operator(plain).collect())), name


def test_near_dedup_keeps_unlike_texts_of_one_doc_id(spark):
    """A doc_id is no document: only rows of like texts go, and those that repeat id and text."""
    texts = [invented(k, 80) for k in range(4)]
    rows = [(8, texts[0]), (8, texts[1]), (9, texts[2]), (9, texts[2]), (5, texts[1]), (None, texts[3]), (None, texts[3].upper()), (None, texts[0]), (3, None), (4, "")]
    kept = nearcopies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = Counter((r.doc_id, (r.text or "").lower()) for r in kept)
    assert found == Counter([(8, texts[0]), (5, texts[1]), (9, texts[2]), (None, texts[3]), (3, "")])


def test_blocks_follow_the_number_of_fingerprints():
    chosen = [simhash.blocks_for(10**k, 4) for k in range(4, 13)]
    assert chosen[0] == 8 and chosen == sorted(chosen) and chosen[-1] > 9


def test_hot_keys_are_joined_whole(spark):
    from deltaloom.llm import spread

    rows = spark.createDataFrame([(k % 7 if k % 2 else 100, k) for k in range(3000)], "key long, x long")
    keys = rows.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "key * 10 AS tenfold")
    found = spread.join_each(rows, keys, "key", 3000 * 2000).collect()  # hot from 600 rows on
    assert Counter((r.key, r.x, r.tenfold) for r in found) == Counter((r.key, r.x, r.key * 10) for r in rows.collect())


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, 250 * 2 / 3, 250 / 3]
    assert mixing.water_fill([], [], 0, 2) == [] and mixing.water_fill([0, 0], [5, 2], 0, 2) == [0.0, 0.0]


def test_mix(spark, none):
    rows = [(k, prose(k, 30 + k % 40), f"s{k % 4}" if k % 7 else None) for k in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.Mixture(many, mixing.Mix(block_words=500, shard_words=2500))
    taken = mix.taken().collect()
    names = {k: s for k, _, s in rows}
    for source in {*names.values()}:
        mine = [r for r in taken if names[r.doc_id] == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 70 and all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    assert sorted(map(tuple, mixing.Mixture(many, mix.mix).taken().collect())) == sorted(map(tuple, taken))
    assert Counter(r.doc_id for r in mix.documents().collect()) == Counter({r.doc_id: r.taken // r.size for r in taken if r.taken})
    blocks = mix.blocks.groupBy("shard").count().collect()
    order = {}
    for r in mix.documents().withColumn("part", F.spark_partition_id()).collect():
        order.setdefault(r.part, []).append(r.doc_id)
    assert 1 < len(order) <= 8  # shards lie in several partitions
    assert len({(r.source_id, r.block) for r in mix.blocks.collect()}) == mix.blocks.count() and max(r["count"] for r in blocks) - min(r["count"] for r in blocks) <= 1
    empty = mixing.Mixture(none)
    assert empty.taken().count() == empty.documents().count() == 0


def test_blocks_grow_with_the_corpus():
    """10^15 words: hypergeometric draws take less than 10^9 blocks, so blocks are longer, and shards have whole blocks."""
    mix = mixing.Mix()
    for total in (1e6, 1e9, 1e15, 1e18):
        size = mixing.block_words(total, mix)
        quotas = [math.ceil(share * total / size) for share in (0.5, 0.3, 0.2)]
        assert sum(quotas) <= mixing.MOST_BLOCKS + 3 and size >= mix.block_words
        plans = [mixing.SourcePlan(str(k), k, 1, total * share, 1, 0.0, n) for k, (n, share) in enumerate(zip(quotas, (0.5, 0.3, 0.2)))]
        shards = mixing.shard_count(plans, mix)
        left, middle = mixing.split(np.array(quotas), 0, shards, sum(quotas), shards, 1) if shards > 1 else (np.array(quotas), 1)
        assert 1 <= shards <= sum(quotas) and left.sum() == sum(quotas) * middle // shards


def test_splits_are_hypergeometric():
    """Means and variances of the left half's quotas over many seeds."""
    quotas, draws = np.array([60, 30, 10]), []
    for seed in range(3000):
        left, middle = mixing.split(quotas, 0, 4, 100, 4, seed)
        draws.append(left)
    draws = np.array(draws)
    assert middle == 2 and (draws.sum(axis=1) == 50).all()
    share = quotas / 100
    assert np.allclose(draws.mean(axis=0), 50 * share, atol=0.25) and np.allclose(draws.var(axis=0), 50 * share * (1 - share) * 50 / 99, rtol=0.12)


def test_chat_against_every_repair():
    costs = chat.Costs()

    def cheapest(codes):
        ways = {chat.START: 0.0}
        for code in codes:
            table, nxt = chat.step(code, costs), {}
            for state, cost in ways.items():
                for role in range(3):
                    nxt[role] = min(nxt.get(role, math.inf), cost + table[state, role])
            ways = nxt
        return min(cost + chat.closing(costs)[s] for s, cost in ways.items())

    draw = np.random.default_rng(3)
    for _ in range(200):
        codes = draw.integers(-1, 3, draw.integers(1, 9)).tolist()
        pieces = [codes[k : k + 3] for k in range(0, len(codes), 3)]
        states = chat.cuts([chat.product(p, costs) for p in pieces], costs)
        out, total = [], 0.0
        for piece, first, last in zip(pieces, states, states[1:]):
            roles = chat.roles_between(piece, first, last, costs)
            for k, role, action in chat.repaired(piece, roles, first, costs):
                if action != "merge":
                    out.append(role)
                total += {"merge": costs.merge, "insert": costs.insert}.get(action, 0)
                if action != "insert" and piece[k] != role:
                    total += costs.unknown if piece[k] < 0 else costs.relabel
        out += chat._AFTER[states[-1]]
        total += chat.closing(costs)[states[-1]]
        talk = out[1:] if out[0] == chat.SYSTEM else out
        assert talk == [chat.USER, chat.ASSISTANT] * (len(talk) // 2) and talk
        assert total == pytest.approx(cheapest(codes))


def test_chat_table(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "bot", "c"), (2, 0, None, None), (None, None, "system", "x"), (1, 2, "bot", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = {r.conv_id: r.rendered for r in chat.render(chat.repair(turns)).collect()}
    assert text[1] == "<|user|>\na\nb\n<|assistant|>\nc\nc\n" and text[2].startswith("<|user|>\n\n<|assistant|>")
    assert text[None] == "<|user|>\nx\n<|assistant|>\n\n"  # a relabel and an insertion cost less than two insertions
    assert chat.repair(turns.where("false")).count() == 0


def test_chat_spread_over_partitions_equals_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_TURNS", 7)
    draw, rows = np.random.default_rng(5), []
    for conv in [None, *range(60)]:
        n = 500 if conv == 7 else int(draw.integers(1, 9))
        rows += [(conv, k, ["user", "gpt", "system", "odd", None][d], f"{conv}-{k}") for k, d in enumerate(draw.integers(0, 5, n))]
    rows += [(3, 0, "user", "3-0"), (3, 0, "user", "3-0")]
    found = {}
    for r in sorted(chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect(), key=lambda r: r.ordinal):
        found.setdefault(r.conv_id, []).append(r)
    costs, given = chat.Costs(), {}
    for row in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] or "")):
        given.setdefault(row[0], []).append(row)
    assert found.keys() == given.keys()
    for conv, turns in given.items():
        codes = [chat.role_code(r[2]) for r in turns]
        assert [(r.turn, r.old_role, r.text) for r in found[conv] if r.action != "insert"] == [r[1:] for r in turns]
        roles = [r.role for r in found[conv] if r.action != "merge"]
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
        actions = Counter(r.action for r in found[conv])
        changed = sum((costs.unknown if chat.role_code(r.old_role) < 0 else costs.relabel) for r in found[conv] if r.action != "insert" and chat.role_code(r.old_role) != chat.ROLES.index(r.role))
        least = (chat.product(codes, costs)[chat.START] + chat.closing(costs)).min()
        assert actions["merge"] * costs.merge + actions["insert"] * costs.insert + changed == pytest.approx(least)


def test_warc_round_trip(spark):
    long, short = "<p>" + "z" * 200, "tiny"
    rows = [(3, "http://a/3", long), (1, "http://a/1", long), (2, None, short), (5, "u", short), (4, "u", None), (None, "u", long), (6, "u", "é" * 90_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 5: ("response", None), 4: ("response", None), 6: ("response", None)}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (found[page].payload_bytes, found[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_warc_damage_is_found():
    data = warc.encode_record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None, "2024-01-01T00:00:00Z")
    assert [r.type for r in warc.WarcReader(io.BytesIO(data + data))] == ["response"] * 2
    plain = zlib.decompress(data, 31)
    for bad in (data[:-9], zlib.compress(plain.replace(b"xxx", b"xyx", 1), wbits=31), zlib.compress(plain + plain, wbits=31)):
        with pytest.raises(warc.WarcError):
            list(warc.WarcReader(io.BytesIO(bad)))


def slow_brown(texts, assigned, model):
    """log10 probability of each (doc_id, text) under an assignment of words to classes, term by term."""
    train, words, pairs = [], Counter(), Counter()
    for doc_id, text in texts:
        if not brown.held_out(doc_id, model):
            found = (text or "").lower().split()
            train.append(found)
            words.update(found)
            pairs.update(zip([0, *(assigned(w) for w in found)], [*(assigned(w) for w in found), 0]))
    total, n = sum(pairs.values()), model.classes + 1
    out = []
    for _, text in texts:
        found, before, score = (text or "").lower().split(), 0, 0.0
        for word in [*found, None]:
            now = 0 if word is None else assigned(word)
            plain = (sum(x for (_, b), x in pairs.items() if b == now) + 1) / (total + n)
            score += math.log10((pairs[before, now] + model.prior * plain) / (sum(x for (a, _), x in pairs.items() if a == before) + model.prior))
            if word is not None:
                mine = [w for w in words if assigned(w) == now]
                score += math.log10((words[word] + model.alpha) / (sum(words[w] for w in mine) + model.alpha * (len(mine) + 1)))
            before = now
        out.append(score)
    return out


def test_brown_counts_and_gain(spark, none):
    draw = np.random.default_rng(4)
    first, second = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    texts = [" ".join(x for _ in range(40) for x in (first[draw.integers(30)], second[draw.integers(30)])) for _ in range(120)] + [None, "", "zz zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = brown.BrownModel(classes=4, rounds=8)
    got = {r.doc_id: r for r in brown.score(docs, model).collect()}
    train = Counter(w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*(t or "").split(), None])
    n, v = sum(train.values()), len(train)
    for k, t in enumerate(texts):
        found = [*(t or "").split(), None]
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 7 == 2) and got[k].n_tokens == len(found) and got[k].train_tokens == n
        assert got[k].n_known == sum(train[w] > 0 for w in found)
        assert got[k].base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in found))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out) * math.log10(2)
    assert brown.score(none).count() == 0


def test_brown_clusters_words_that_are_not_frequent(spark):
    """Two sets of words take turns; their last two bytes don't tell them apart. Repeated rows, rows without id and texts
    without words are texts of their own, and a word seen once stays where its group is."""
    draw = np.random.default_rng(6)
    first, second = [f"a{k}x" for k in range(60)], [f"b{k}x" for k in range(60)]
    texts = [" ".join(x for _ in range(40) for x in (first[draw.integers(60)], second[draw.integers(60)])) for _ in range(150)] + [None, "new words a1x", "a1x a1x"]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bits = {}
    for min_count in (2, 10**9):
        model = brown.BrownModel(classes=4, frequent=5, word_rounds=6, min_count=min_count, chunk_tokens=1000, bucket_words=50)
        scored = brown.score(docs, model).collect()
        assert Counter(r.doc_id for r in scored) == Counter(k for k, _ in rows)
        out = [r for r in scored if r.held_out]
        bits[min_count] = -sum(r.score for r in out) / math.log10(2) / sum(r.n_tokens for r in out)
    assert bits[2] < bits[10**9] - 0.5
    assert bits[2] == pytest.approx(math.log2(60), abs=0.6)


def test_brown_score_term_by_term(spark):
    """With no moves every word's class is known: that of its rank or of its group."""
    texts = [(k, invented(k % 7, 30 + k) + " " + prose(k, 20)) for k in range(25)] + [(25, None), (26, "once only here"), (None, "the the fox")]
    model = brown.BrownModel(classes=5, frequent=6, groups=16, rounds=0, min_count=10**9, chunk_tokens=200, bucket_words=40)
    words = Counter(w for k, t in texts if not brown.held_out(k, model) for w in (t or "").lower().split())
    ranked = sorted(words, key=lambda w: (-words[w], np.uint64(brown.key_of(w.encode())).view(np.int64)))[:6]
    first = {w: 1 + k % 5 for k, w in enumerate(ranked)}

    def assigned(word):
        return first.get(word) or 1 + (6 + brown.group_of(word.encode(), model)) % 5

    found = {r.doc_id: r.score for r in brown.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), model).collect()}
    for (k, _), want in zip(texts, slow_brown(texts, assigned, model)):
        assert found[k] == pytest.approx(want)


def test_exchange_finds_the_best_class():
    """Against the likelihood of every assignment that differs in one word."""
    draw, n = np.random.default_rng(0), 6
    bigrams = draw.poisson(0.7, (40, 40)).astype(float)
    bigrams[5, 5], bigrams[7, 7] = 9, 40
    classes = 1 + np.arange(40) % (n - 1)
    classes[0] = 0

    def table(of):
        out = np.zeros((n, n))
        np.add.at(out, (of[:, None], of[None, :]), bigrams)
        return out

    left = np.stack([np.bincount(classes, weights=bigrams[:, t], minlength=n) for t in range(40)])
    right = np.stack([np.bincount(classes, weights=bigrams[t], minlength=n) for t in range(40)])
    found = exchange.best_classes(classes[1:], left[1:], right[1:], np.diagonal(bigrams)[1:], table(classes))
    for t, to in zip(range(1, 40), found):
        scores = []
        for c in range(1, n):
            other = classes.copy()
            other[t] = c
            scores.append(exchange.likelihood(table(other)))
        assert scores[to - 1] == pytest.approx(max(scores))
    after, kept = exchange.cluster(bigrams, classes, n, 10, 1e-6)
    assert np.allclose(kept, table(after)) and exchange.likelihood(kept) > exchange.likelihood(table(classes))


def test_ids_and_counts(docs, none):
    whole = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [[*whole.encode([t])[0], 0] for _, t in rows]
    expected, start = [], 0
    for (k, _), x in zip(rows, ids):
        expected.append((k, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    assert Counter(map(tuple, idstore.store_and_read(docs).collect())) == Counter(expected)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        encoder = tokens.Encoder(tokens.tokenizer_path(name))
        want = Counter((k, len(t.encode()), len(encoder.encode([t])[0]), len(encoder.encode([t])[0]) > 1024) for k, t in rows)
        assert Counter(map(tuple, tokencount.count_tokens(docs, name).collect())) == want
    assert idstore.store_and_read(none).count() == tokencount.count_tokens(none).count() == 0


def test_parts_keep_ids():
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    odd = ["a \n b", "x<|endoftext|> y<|endoftext|>", "  lead", "tail  \n ", "a\x1c b!\x1c\x1d", "it's they'll\t\t no", " ", " a　 b", "word's,,, 12ab", "日本 語"]
    cache = tokens.IdCache(encoder)
    draw = random.Random(3)
    odd += ["".join(draw.choices(["a", "Bé", ",", "7", " ", " ", "\n", "\t", "\r", "\u3000", "\0", "'s"], k=draw.randrange(1, 14))) for _ in range(3000)]
    assert [cache.ids(t).tolist() for t in odd] == encoder.encode(odd)


def test_ids_of_many_texts_at_once():
    """each() gives the ids of the library, whatever the texts before and after one are."""
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    draw = random.Random(5)
    signs = ["a", "Bé", ",", "7", " ", " ", "\n", "\t", "\r", "\u3000", "\xa0", "\x85", "\u1680", "\u2009", "\u2028", "\u205f", "\x1c", "日", "\0", "'s", "<|endoftext|>"]
    texts = ["", None, *["".join(draw.choices(signs, k=draw.randrange(14))) for _ in range(5000)], *[prose(k, 300) for k in range(20)]]
    expected = [[*ids, 0] for ids in encoder.encode([t or "" for t in texts])]
    few = tokens.IdCache(encoder, 100)
    for cache in (few, few, tokens.IdCache(encoder)):
        for rows, want in ((pa.array(texts), expected), (pa.array(texts)[9:], expected[9:]), (pa.array(texts, pa.large_string()), expected), (pa.array([None, ""], pa.string()), [[0], [0]])):
            assert [x.tolist() for x in cache.each(rows, 0)] == want
    assert few.each(pa.array([], pa.string()), 0) == []


def test_ids_of_parts_together():
    """Parts that are encoded as one text have the ids that each has alone."""
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    draw = random.Random(6)
    signs = ["a", "Bé", "ß", "ȿ", "×", ",", "7", "'s", "日", "\u3000", "\xa0", "\x85", "\0", "<|end", "of"]
    parts = {draw.choice([" ", "\n", "\t ", "", ""]) + "".join(draw.choices(signs, k=draw.randrange(1, 9))) for _ in range(4000)}
    parts |= {" \x1c", " a\x1f", " ", "\r\n", *[f" {'x' * k}" for k in range(1, 300)]}
    names, ids, sizes = encoder.encode_parts([p.encode() for p in parts])
    assert sorted(names) == sorted(p.encode() for p in parts) and len(ids) == sum(sizes)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == encoder.encode([n.decode() for n in names])
    encoder.bytes_of[int(ids[0])] += 1  # ids that do not tell the parts apart are not used
    names, ids, sizes = encoder.encode_parts([p.encode() for p in parts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == encoder.encode([n.decode() for n in names])
    names, ids, sizes = encoder.encode_parts([b" a", b" <|endoftext|>"])
    assert names == [b" a", b" <|endoftext|>"] and encoder.encode_parts([])[0] == []


def test_parts_met_again_stay_known():
    """What a cache beyond its bound gives up is what it met once: words of every text are encoded once in all."""
    encoder, asked = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json")), []
    merge, encode = encoder._merge, encoder._encode
    encoder._merge = lambda word: asked.append(word) or merge(word)
    encoder._encode = lambda texts: asked.extend(texts) or encode(texts)
    cache = tokens.IdCache(encoder, 300)
    for k in range(30):
        fresh = [f"{'bcdfg'[j % 5]}{'aeiou'[j // 5 % 5]}é{'xyz'[j // 25 % 3]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for j in range(75)]
        text = " ".join([x for j in range(75) for x in (WORDS[j % len(WORDS)], fresh[j])])
        assert [x.tolist() for x in cache.each(pa.array([text]), 0)] == [[*encode([text])[0], 0]]
        assert len(cache.place) <= 300 + 2 * 75
    assert max(Counter(re.findall("[a-zé]+", " ".join(asked).replace("\u0120", " ").replace("Ã©", "é"))).values()) <= 2  # a text's first word has no blank


def test_blocks_of_the_jvm_are_those_of_numpy(spark):
    """The same bytes and ids, in a small part of the time."""
    draw = np.random.default_rng(4)
    blocks = [np.array([5]), np.array([7] * 9000), draw.integers(0, 50257, 9001), draw.integers(0, 3, 70_001), draw.zipf(1.1, idfile.BLOCK_IDS) % 50257]
    blocks = [b.astype("<u4") for b in blocks]
    began = time.process_time()
    expected = [idfile.parts_of(idfile.write_ids(idfile.Documents([], np.zeros(0, dtype=np.int64), b), 50257))[0][0] for b in blocks]
    by_numpy = time.process_time() - began
    rows = spark.createDataFrame([(k, b.tobytes()) for k, b in enumerate([*blocks, *blocks])], "k int, ids binary").repartition(1).cache()
    times = []
    for _ in range(4):  # the JVM compiles the first
        began = time.time()
        coded = {r.k: bytes(r.block) for r in rows.select("k", blockcoder.block_of(spark, F.col("ids"), F.lit(50257)).alias("block")).collect()}
        times.append(time.time() - began)
    assert [coded[k] for k in range(len(blocks))] == expected
    assert min(times) < by_numpy  # for each block twice
    back = spark.createDataFrame(list(coded.items()), "k int, block binary").select("k", blockcoder.ids_of(spark, F.col("block"), F.lit(50257)).alias("ids"))
    assert all(bytes(r.ids) == blocks[r.k % len(blocks)].tobytes() for r in back.collect())
    broken = bytearray(expected[2])
    broken[3000] ^= 1
    with pytest.raises(Exception, match="damaged"):
        spark.createDataFrame([(bytes(broken),)], "block binary").select(blockcoder.ids_of(spark, F.col("block"), F.lit(50257))).collect()


def test_id_file_round_trip_and_damage(monkeypatch):
    draw = np.random.default_rng(2)
    pairs = np.cumsum(draw.integers(0, 3, 30_000)) % 997
    for ids in ([], [0], [7] * 9000, draw.integers(0, 50257, 9001), draw.zipf(1.3, 20_000) % 50257, pairs, [(1 << 20) - 1, 3, 3]):
        ids = np.array(ids, dtype=np.uint32)
        held = idfile.Documents([5, None], np.array([len(ids), 0]), ids)
        for vocabulary in (50257, 1 << 20) if not len(ids) or ids.max() < 1 << 16 else (1 << 20,):
            back = idfile.read_ids(idfile.write_ids(held, vocabulary, 9000 if vocabulary == 50257 else idfile.BLOCK_IDS))
            assert back.doc_ids == [5, None] and back.ids.tolist() == ids.tolist() and back.lengths.tolist() == [len(ids), 0]
    data = bytearray(idfile.write_ids(idfile.Documents([1], np.array([9000]), np.arange(9000, dtype=np.uint32)), 50257))
    data[300] ^= 1
    with pytest.raises(idfile.IdFileError):
        idfile.read_ids(bytes(data))


def test_id_blocks_stand_alone():
    """A block has the same codes whatever blocks stand beside it."""
    draw = np.random.default_rng(3)
    blocks = [(draw.zipf(1.2, n) % 3000).astype(np.uint32) for n in (5000, 700, 5000, 1)]
    together = idfile.encode_blocks(blocks, 3000)
    assert [idfile.encode_blocks([b], 3000)[0] for b in blocks] == together
    alone = idfile.decode_blocks([[np.frombuffer(c, ">u4") for c in together[2]]], [5000], 3000)
    assert alone[0].tolist() == blocks[2].tolist()


def test_id_coder_beats_order_0():
    """Bits per id below those of an adaptive order-0 coder and of the static entropy, on ids of texts."""
    cache = tokens.IdCache(tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json")))
    ids = np.concatenate([cache.ids(prose(k, 400), 0) for k in range(60)])
    share = np.bincount(ids) / len(ids)
    static = -(share[share > 0] * np.log2(share[share > 0])).sum()
    seen, adaptive = Counter(), 0.0
    for k, x in enumerate(ids.tolist()):
        adaptive -= math.log2((seen[x] + 1 / 64) / (k + 50257 / 64))
        seen[x] += 1
    coded = 8 * sum(map(len, idfile.encode_blocks([ids], 50257)[0])) / len(ids)
    assert coded < 0.9 * adaptive / len(ids) and coded < static


def test_leaks(spark, none):
    items = [(k, f"What is {prose(50 + k, 14)}? It is {prose(90 + k, 8)}.") for k in range(30)] + [(99, None), (98, "")]
    texts = [prose(k, 700) for k in range(20)]
    texts[3] = f"{prose(3, 301)} {items[4][1].upper()} {prose(4, 500)}"
    texts[7] = items[5][1] + " " + items[6][1]
    texts[9] = prose(9, 200) + " " + items[7][1][: len(items[7][1]) // 2]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (3, texts[3])], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter({(3, 4): 2, (7, 5): 1, (7, 6): 1})
    for search in (decontaminate.Search(), decontaminate.Search(index_bytes=1000)):
        assert Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table, search).collect()) == expected
    assert decontaminate.drop_contaminated(docs, table).count() == len(texts) + 2 - 3
    assert decontaminate.find_leaks(none, table).count() == decontaminate.find_leaks(docs, table.where("false")).count() == 0


def test_index_retrieves_all_above_the_threshold(monkeypatch):
    """Against BM25 computed here, over all passages and items; however many sums are held at a time."""
    items = [(k, prose(200 + k, 15 + k % 9)) for k in range(40)]
    listed = [decontaminate.terms(t) for _, t in items]
    frequency, mean = Counter(w for x in listed for w in set(x)), sum(map(len, listed)) / 40

    def bm25(word, found):
        tf, idf = found.count(word), math.log(1 + (40 - frequency[word] + 0.5) / (frequency[word] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(found) / mean))

    index = decontaminate.Index(items, frequency, 40, mean, decontaminate.Search(threshold=0.55))
    text, longest = prose(777, 700), max(map(len, listed))
    words, want = decontaminate.terms(text), set()
    for start in range(0, max(1, len(words) - longest), longest):
        here = set(words[start : start + 2 * longest])
        want |= {(k, start) for k, found in enumerate(listed) if sum(bm25(w, found) for w in set(found) & here) >= 0.55 * sum(bm25(w, found) for w in set(found))}
    for cells in (1, 50, 1 << 21):
        monkeypatch.setattr(decontaminate, "_CELLS", cells)
        assert {(item, start) for item, start, _ in index.candidates(text)} == want and want


def test_leaks_with_a_changed_word(spark):
    """An item is found when one word of its short answer is another; not when half of it is."""
    item = f"What is {prose(60, 30)}? It is {prose(61, 5)}."
    words = item.split()
    texts = [" ".join([*words[:-3], "other", *words[-2:]]), " ".join(w if k % 2 else "other" for k, w in enumerate(words)), prose(5, 200)]
    docs = spark.createDataFrame([(k, prose(70 + k, 50) + " " + t + " " + prose(80 + k, 50)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(0, 7)]


def test_many_items_and_a_long_text_stay_small():
    """20,000 items against 200,000 words: sums are held for some passages at a time, not for all of both."""
    import tracemalloc

    draw = random.Random(4)
    words = [f"w{k}" for k in range(6000)]
    items = [(k, " ".join(draw.choices(words, k=16))) for k in range(20_000)]
    frequency = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, frequency, 20_000, 16.0, decontaminate.Search())
    text = " ".join(draw.choices(words, k=100_000)) + " " + items[77][1] + " " + " ".join(draw.choices(words, k=100_000))
    tracemalloc.start()
    found = index.leaks(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[0] for x in found] == [77] and peak < 200e6


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_license_scan(text, listed):
    """(labels, score, begins, ends) by comparing every five words of a text to every five of every template."""
    got, found, best = license_words(text), set(), None
    for label, passages in listed.items():
        for passage in passages:
            want = license_words(passage)
            where = {}
            for at in range(len(want) - 4):
                where.setdefault(tuple(want[at : at + 5]), []).append(at)
            diagonals = {}
            for k in range(len(got) - 4):
                for at in where.get(tuple(got[k : k + 5]), ()):
                    diagonals.setdefault(k - at, []).append((k, at))
            spans, last = [], None
            for d in sorted(diagonals):
                if last is None or d - last > 8:
                    spans.append([])
                spans[-1] += diagonals[d]
                last = d
            for hits in spans:
                coverage, begins, ends = len({at for _, at in hits}) / (len(want) - 4), min(hits)[0], max(hits)[0] + 5
                if coverage >= 0.5 or (len(hits) >= 40 and ends - begins <= 1.5 * len(hits)):
                    found.add(label)
                    best = max(best or (0.0, "", 0, 0), (coverage, label, begins, ends))
    base = {(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(got)) if got[i : i + len(phrase.split())] == phrase.split()}
    score = max(best[0] if best else 0.0, 0.5 if base or best else 0.0)
    return ",".join(sorted(found | {x for _, x in base})), score, *(best[2:] if best else (None, None)), sorted(base)


def test_licenses_against_brute_force(spark, none):
    listed, draw = licenses.templates(), random.Random(5)
    mit, gpl, apache = licenses.license_texts()["mit"][0], licenses.license_texts()["gpl"][1], licenses.license_texts()["apache"][0]
    cut = mit.split()
    texts = [
        "Released under the MIT License, or the mit license.", "x " * 30 + mit.upper() + " y", " ".join(cut[:20] + ["new"] + cut[20:]), "Apache-License! GNU general public license",
        None, "", "mit licenses", "été MITé license", "You may use it under CC BY-SA 4.0.", "Available under a Creative Commons Attribution-NonCommercial 3.0 Unported License",
        " ".join(gpl.split()[500:560]), " ".join(gpl.split()[500:530]), mit + " " + prose(3, 40) + " " + mit, prose(5, 900), gpl, " ".join(apache.split()[::-1]),
        " ".join(cut[k + draw.randrange(3)] for k in range(0, len(cut) - 3)), "permission is hereby granted free of charge " * 40,
    ]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (1, texts[1])], "doc_id long, text string").repartition(3)
    rows = licenses.scan(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*range(len(texts)), None, 1])
    found = {r.doc_id: r for r in rows}
    for k, text in enumerate(texts):
        r, (labels, score, begins, ends, places) = found[k], slow_license_scan(text, listed)
        assert (r.n_words, r.n_base, r.base_labels) == (len(license_words(text)), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert (r.labels, r.score, r.span_begins, r.span_ends) == (labels, pytest.approx(score), begins, ends)
    assert found[1].labels == "mit" and found[2].labels == "mit" and found[8].labels == found[9].labels == "cc" and "gpl" in found[10].labels and found[11].labels == ""
    assert licenses.scan(none).count() == 0


def test_license_scan_of_a_very_long_text(spark):
    """320,000 words in time that follows their number; formerly it followed its square."""
    import time

    words = [w for k in range(40) for w in prose(k, 8000).split()]
    words[160_000:160_000] = licenses.license_texts()["isc"][0].split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "doc_id long, text string")
    licenses.scan(docs.where("doc_id = 2")).collect()
    began = time.time()
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert found[1].labels == "isc" and found[1].score == 1.0 and found[1].span_begins == 160_000 and time.time() - began < 60


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Kept documents worked out here; the mix's multiplicities from its operator; ids from the library."""
    import corpus_pipeline as pipeline

    item = f"What is {prose(70, 14)}? It is {prose(71, 8)}."
    texts = [invented(10, 90), invented(10, 90).upper(), invented(11, 120), invented(12, 70) + " " + item, "short", None, invented(13, 150), invented(13, 150) + " end", *[invented(k, 60 + k) for k in range(20, 40)]]
    rows = [(k, t, "en", f"s{k % 2}", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {k: t for k, t, *_ in rows}
    folded = lambda t: [tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)]
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            kept = {k: t for k, t in kept.items() if slow_verdict(t, compression.Bands())[-1]}
        elif name == "near_dedup":
            for k in sorted(kept):
                for j in [j for j in kept if j > k and k in kept]:
                    a, b = set(folded(kept[k])), set(folded(kept[j]))
                    if len(a & b) >= 0.8 * len(a | b):
                        del kept[j]
        else:
            kept = {k: t for k, t in kept.items() if item not in t}
        assert sorted(map(tuple, docs.select("doc_id", "text").collect())) == sorted(kept.items())
    copies = {r.doc_id: r.taken // r.size for r in mixing.Mixture(docs).taken().collect()}
    assert sum(copies.values()) > len(kept) and {*copies.values()} <= {0, 1, 2}
    encoder, expected, start = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json")), [], 0
    for k in sorted(kept):
        ids = [*encoder.encode([kept[k]])[0], 0]
        for _ in range(copies[k]):
            expected.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == expected
    empty = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert pipeline.run(spark, str(empty)).count() == 0
