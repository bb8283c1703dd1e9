"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, extra columns
of clashing names and no rows at all, against brute force."""

import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lemmaflow.llm import common, divergence, licenses, lines, mixing, negatives, packing, quality, simhash, spans, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_id string, score double, pop int"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


def table(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["s"])[k % len(sources or ["s"])], len(t or ""), "x", 0.5, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "idiot", "iota"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) + "." for _ in range(60)]
    base = " ".join(f"word{k}" for k in range(300))
    texts += [base, base, base.replace("word150 ", "other "), None, "", " \t\n", LONG, "Released under the MIT License.", "licensed under the Apache License, Version 2.0!"]
    df = table(spark, texts, ["a", "b", None])
    extra = spark.createDataFrame([(None, base, None, None, 1, None, None, None), (3, texts[3], "en", "a", 1, "x", 0.5, 1)], SCHEMA)
    return df.union(extra).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_simhash_matches_brute_force(docs):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        parts = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.select("doc_id", "text").collect()
    own = [(r.doc_id, fingerprint(r.text)) for r in rows if r.text != LONG]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs).collect()]
    assert len(got) == len(rows)
    assert Counter(own) <= Counter((d, f) for d, f, _ in got)
    group = {k: {k} for k in {f for _, f, _ in got}}
    for a in list(group):
        for b in list(group):
            if bin(a ^ b).count("1") <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    least = {f: min(d for d, g, _ in got if g in group[f] and d is not None) for f in group}
    assert all(c == least[f] for _, f, c in got)


def test_near_copies_leave_one(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum((r.text or "").startswith("word0 ") for r in rows) == 1
    assert sum(not words(r.text) for r in rows) == 1
    assert sum(r.text == LONG for r in rows) == 1


def test_near_copies_have_the_similarity(spark):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(40):
        own = [f"v{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(own))
        for n in (2, 4, 7):  # substituted words, each in five shingles: similarity 0.84, 0.71, 0.54
            other = list(own)
            for at in np.linspace(5, 110, n).astype(int):
                other[at] = f"n{k}x{at}"
            texts.append(" ".join(other))
    repeats = ["buy now " * 60 + f"offer {k} " * 40 + " ".join(f"z{k}y{x}" for x in range(30)) for k in range(6)]
    texts += repeats + ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g x"]
    sets = [{tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = sorted({r: min(k for k in range(len(texts)) if root[k] == r) for r in root}.values())
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table(spark, texts)).collect()) == want


def test_jaccard_forest_in_blocks(spark):
    rng = np.random.default_rng(13)
    base = [f"v{x}" for x in range(200)]
    texts = [" ".join(w if rng.random() > 0.02 else f"n{k}" for w in base) for k in range(60)]
    docs = table(spark, texts)
    prints = simhash.set_prints(docs, 5, 1).selectExpr("set_id", "key_id", "key_text", "cast('g' as binary) as root", "60L as n")
    name = {bytes(r.set_id): r.key_id for r in prints.collect()}

    def groups(block):
        root = list(range(60))
        for r in simhash.verified_links(docs, prints, 5, 0.8, block).collect():
            i, j = name[bytes(r.a)], name[bytes(r.b)]
            root = [root[i] if x == root[j] else x for x in root]
        return {frozenset(k for k in range(60) if root[k] == r) for r in root}

    assert groups(1000) == groups(7) and 1 < len(groups(7)) < 60


def test_components_of_a_chain_and_a_star(spark):
    from lemmaflow.llm.common import components

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (1, 2)]
    got = dict(components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


@pytest.mark.parametrize("words_", [1, 4])
def test_tile_forest_has_all_links(words_):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, (600, words_), dtype=np.uint64)
    x[300:] = x[:300] ^ (np.uint64(1) << rng.integers(0, 64, (300, words_)).astype(np.uint64))
    child, root = simhash.tile_forest(x, None, 4 * words_, 64, 128)
    assert set(zip(child.tolist(), root.tolist())) >= set() and len(child) == 300


def test_lines_on_many_sites(spark):
    texts = [f"own {k} text here\n Common  footer line here \nTail." for k in range(12)] + [None, "", "a\n\nb"]
    df = table(spark, texts, [f"s{k}" for k in range(12)])
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_cross_site_lines(df, min_sites=10, min_words=3).collect()}
    assert got[0] == (texts[0], 0)
    assert all(got[k] == (f"own {k} text here\nTail.", 1) for k in range(1, 12))
    assert got[12] == (None, 0) and got[13] == ("", 0) and got[14] == ("a\n\nb", 0)
    short = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_cross_site_lines(df, min_sites=10).collect()}
    assert short[0] == (texts[0], 0) and all(short[k] == (f"own {k} text here", 2) for k in range(1, 12))
    nine = table(spark, texts[:9], [f"s{k}" for k in range(12)])
    assert all(r.n_removed == 0 for r in lines.remove_cross_site_lines(nine, min_sites=10).collect())


def test_pipeline_takes_short_lines_of_many_sites(spark):
    import corpus_pipeline

    texts = [f"own {k} text here\nTail.{' \t\r'[k % 4:]}\n版权所有 here\nlast {k}" for k in range(12)]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, table(spark, texts, [f"s{k}" for k in range(12)]), "").collect()}
    assert got == {k: texts[k] if not k else f"own {k} text here\nlast {k}" for k in range(12)}


def test_repeated_spans_go_but_the_first(spark):
    passage = "The first sentence has some words. The second one follows it here. And the third ends it all now."
    texts = [f"Intro number {k} is alone. {passage} Outro of {k}." for k in range(5)] + [None, "", passage, LONG]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeated_spans(table(spark, texts), min_words=12).collect()}
    assert got[0][0] == texts[0]
    assert all(got[k] == (f"Intro number {k} is alone. Outro of {k}.", 3) for k in range(1, 5))
    assert got[5] == (None, 0) and got[6] == ("", 0) and got[7] == ("", 3) and got[8][0] == LONG
    for text in texts:
        assert b"".join(spans.sentences((text or "").encode())[0]) == (text or "").encode()


@pytest.mark.parametrize("ends", [0, 1, 2, 3, 4])
def test_passages_glued_at_both_ends_go(spark, ends):
    own = [f"p{k}" for k in range(60)]
    for k in range(ends):
        own[(k + 1) * 60 // (ends + 1)] += "."
    passage = " ".join(own)
    texts = [" ".join(f"a{k}x{j}" for j in range(33 + k)) + f" {passage} " + " ".join(f"b{k}x{j}" for j in range(41)) for k in range(4)]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeated_spans(table(spark, texts)).collect()}
    assert got[0] == (texts[0], 0)
    for k in range(1, 4):
        left = [w for w in words(got[k][0]) if w in own]
        assert len(left) <= 36 and got[k][1] > 0 and all(w in words(got[k][0]) for w in words(texts[k]) if w not in own)
        inside = [w in left for w in own]  # what is left is at the ends, each shorter than a row of windows
        assert inside.index(False) < 27 and inside[::-1].index(False) < 27


def test_one_or_two_whole_sentences_go(spark):
    one = " ".join(f"o{k}" for k in range(30)) + "."
    two = " ".join(f"t{k}" for k in range(14)) + ". " + " ".join(f"u{k}" for k in range(14)) + "."
    texts = [f"Begin {k} here. {one} Middle {k} of it. {two} End {k}." for k in range(3)]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeated_spans(table(spark, texts), min_words=24).collect()}
    assert got[0] == (texts[0], 0)
    assert all(got[k] == (f"Begin {k} here. Middle {k} of it. End {k}.", 3) for k in (1, 2))


def test_spans_match_brute_force(spark):
    """A run or window is removed if, and only if, its words stand together in an earlier place; a
    document that shares under 36 words in a row with others, and repeats none, is left alone."""
    rng = np.random.default_rng(21)
    parts = [" ".join(f"p{k}w{j}" + "." * (rng.random() < 0.1) for j in range(int(rng.integers(20, 90)))) for k in range(25)]
    texts = []
    for k in range(80):
        own = [f"own{k}n{j}" for j in range(int(rng.integers(5, 60)))]
        for part in rng.choice(parts, int(rng.integers(0, 3)), replace=False):
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = part.split()
        texts.append(" ".join(own))
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.remove_repeated_spans(table(spark, texts)).collect()}
    seen: set = set()
    for k, text in enumerate(texts):
        w = text.split()
        windows = {n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for n in (36, 50)}
        if not any(x in seen for x in windows[36]):
            assert got[k] == (text, 0)
        if any(x in seen for x in windows[50]):
            assert got[k][1] > 0
        left = got[k][0].split()
        covered = {i + j for i, x in enumerate(windows[36]) if x in seen for j in range(36)}
        sentence = set()  # whole sentences of a repeated run may go, glued words never
        assert [x for i, x in enumerate(w) if i not in covered | sentence] == [x for x in left if x not in {w[i] for i in covered}]
        runs = [i for i, x in enumerate(windows[50]) if x in seen]
        for i in runs:  # of 50 words in a row that came before, fewer than 15 at either end are left
            kept = [x in left for x in w[i : i + 50]]
            assert kept.count(True) <= 28
        seen |= set(windows[36]) | set(windows[50])


def test_packed_tokens_come_back(docs):
    packed = tokens.pack_tokens(docs, size=256).cache()
    encoder = tokens.public_encoder()
    want = Counter((r.doc_id, np.append(encoder.slow.encode(r.text or "", add_special_tokens=False).ids, 50256).astype("<u4").tobytes()) for r in docs.select("doc_id", "text").collect())
    pieces = defaultdict(list)
    for r in packed.collect():
        assert r.cu_seqlens[-1] == r.n_tokens <= 256 and len(r.ids) == 4 * 256 == len(r.position_ids)
        assert set(r.ids[4 * r.n_tokens :]) <= set(np.uint32(50256).tobytes()) and not any(r.position_ids[4 * r.n_tokens :])
        assert np.array_equal(np.frombuffer(r.position_ids, "<u4")[: r.n_tokens], np.concatenate([np.arange(b - a) for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])]))
    for r in tokens.unpack_tokens(packed).collect():
        pieces[r.doc_id].append((r.piece, r.ids))
    for doc, text in ((d, t) for d, t in want if d is not None and d != 3):
        assert b"".join(x for _, x in sorted(pieces[doc])) == text


def test_ids_are_the_tokenizers_and_packed_files_come_back(spark, tmp_path):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" * 50, "  two  blanks\n\n", "plain words", ""]
    encode = tokens.public_encoder().ids
    assert [encode(t).tolist() for t in texts] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    tokens.write_packed(tokens.pack_tokens(table(spark, texts), size=16, end_id=50256), str(tmp_path / "packed"))
    files = spark.read.parquet(str(tmp_path / "packed"))
    matrix = np.frombuffer(b"".join(bytes(r.ids) for r in files.collect()), "<u4").reshape(-1, 16)
    assert len(matrix) == files.count()
    back = defaultdict(list)
    for r in tokens.unpack_tokens(files).collect():
        back[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    for k, t in enumerate(texts):
        assert sum((x for _, x in sorted(back[k])), []) == own.encode(t, add_special_tokens=False).ids + [50256]


def test_pieces_reach_one_python_worker_of_a_task(spark):
    texts = ["a b c"] * 50 + ["word " * 100, None]
    packed = tokens.pack_tokens(table(spark, texts), size=16, block=20)
    above, below = packed._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)
    assert above.count("MapInArrow") == 1 == below.count("MapInArrow")
    lengths = [len(tokens.public_encoder().ids(t or "")) + 1 for t in texts]
    rows = packed.collect()
    assert sum(r.n_tokens for r in rows) == sum(lengths) and len({r.sequence_id for r in rows}) == len(rows)
    assert sum(r.n_tokens == 16 for r in rows) >= lengths[50] // 16  # pieces as long as a sequence are alone in it
    assert tokens.pack_tokens(table(spark, texts).limit(0)).count() == 0


def test_sequences_do_not_follow_the_file_layout(spark):
    rng = np.random.default_rng(15)
    texts = [" ".join(rng.choice(["red", "green", "blue"], rng.integers(1, 60))) for _ in range(400)]
    df = table(spark, texts)
    count = lambda rows: packing.pack_minimum_slack(rows, size=64).select("sequence_id").distinct().count()
    total = packing.pack_minimum_slack(df, size=64).agg({"length": "sum"}).first()[0]
    assert count(df.repartition(40)) <= -(-total // 64) * 1.02 + 2 and abs(count(df.repartition(40)) - count(df.coalesce(1))) <= 2


def test_minimum_slack_fills_and_keeps_all(docs):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1024, 3000).tolist()
    bins = packing.minimum_bin_slack(lengths, 1024)
    assert sorted(k for b in bins for k in b) == list(range(3000))
    assert all(sum(lengths[k] for k in b) <= 1024 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 1024) * 1.01 + 2
    best = tokens.best_fit_decreasing(lengths, 1024)
    assert sorted(k for b in best for k in b) == list(range(3000)) and all(sum(lengths[k] for k in b) <= 1024 for b in best)
    rows = packing.pack_minimum_slack(docs, size=128).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.fullest([5, 3, 2], {5: 1, 3: 1, 2: 1}, 4) == [3] and packing.fullest([7], {7: 2}, 6) == []


def test_mix_meets_targets_and_reruns_agree(spark, docs):
    report = mixing.mix_report(docs)
    a, b = sorted(map(str, report.collect())), sorted(map(str, mixing.mix_report(docs).collect()))
    assert a == b and len(a) == docs.count()
    by = defaultdict(list)
    for r in report.collect():
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    total = sum(r.size for rows in by.values() for r in rows)
    assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-6
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and rows[0].target <= 3 * rows[0].source_size
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(len(r.shards) for rows in by.values() for r in rows)
    even = table(spark, [f"{'x ' * (k % 7 + 1)}" for k in range(900)], ["a", "b", "c"])
    sums = defaultdict(int)
    for r in mixing.mix_report(even).collect():
        sums[r.source] += r.taken
    whole = sum(k % 7 + 1 for k in range(900))
    assert all(abs(sums[s] - whole * w / 6) <= 7 for s, w in (("a", 1), ("b", 2), ("c", 3)))


def test_hypergeometric_draws(spark):
    """Against numpy's distribution, by a chi-square over all outcomes of several urns."""
    from pyspark.sql import functions as F

    for total, marked, drawn in ((50, 20, 25), (9, 3, 4), (1000, 5, 500), (12, 12, 6), (7, 0, 3)):
        u = F.pmod(F.xxhash64("id"), F.lit(2**53)) / F.lit(float(2**53))
        args = [F.lit(x).cast("long") for x in (total, marked, drawn)]
        got = Counter(r[0] for r in spark.range(8000).select(mixing.hypergeometric(*args, u)).collect())
        low, high = max(0, drawn + marked - total), min(drawn, marked)
        chance = {k: math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(low, high + 1)}
        assert set(got) <= set(chance)
        often = {k: p for k, p in chance.items() if 8000 * p >= 5}
        assert sum((got[k] - 8000 * p) ** 2 / (8000 * p) for k, p in often.items()) < len(often) + 6 * math.sqrt(2 * len(often)) + 6


def test_tree_keeps_quotas(spark):
    quotas = [(1, 700), (2, 40), (3, 0), (4, 1301)]
    root = spark.createDataFrame([(quotas,)], "quotas array<struct<sid:int,q:long>>")
    leaves = mixing.split_quotas(root, 4).collect()
    assert sorted(r.shard for r in leaves) == list(range(16))
    for k, (sid, q) in enumerate(quotas):
        assert sum(r.quotas[k].q for r in leaves) == q and all(r.quotas[k].sid == sid and r.quotas[k].q >= 0 for r in leaves)
    sizes = [sum(x.q for x in r.quotas) for r in leaves]
    assert max(sizes) - min(sizes) <= 4  # each node halves its slots


def test_mix_finds_shards_by_halving(spark):
    """A row's shard is that of its slot, and finding it takes no pass over all shards."""
    from pyspark.sql import functions as F

    df = table(spark, [f"{'x ' * (k % 7 + 1)}{k}" for k in range(3000)], ["a", "b", None])
    mix = mixing.Mix(df, 3, block_docs=1, shard_words=4)
    placed = mix.placed(mix.sized)
    rows = placed.select("starts", "blocks", "placements", F.transform("placements", lambda p: p["pass"].cast("long") * F.col("blocks") + mixing._turn(p["pass"].cast("long"))).alias("slots")).collect()
    assert sum(len(r.placements) for r in rows) > 2000
    for r in rows:
        assert len(r.starts) == 1024 and [p.shard for p in r.placements] == [sum(s <= x for s in r.starts) - 1 for x in r.slots]
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(starts" not in plan


def test_mix_comes_through_the_tree(spark, monkeypatch):
    """Shards draw disjoint slots and together just what is taken; without the tree's quotas nothing is taken."""
    from pyspark.sql import functions as F

    df = table(spark, [f"{'x ' * (k % 7 + 1)}{k}" for k in range(2000)], ["a", "b", "c", None])
    mix = mixing.Mix(df, 3, block_docs=4)
    own = {r.source: r for r in mix.sources.collect()}
    slots = defaultdict(set)
    for r in mix.placed(mix.sized).select("source", "u", "placements").collect():
        for p in r.placements:
            starts = own[r.source].starts
            slots[r.source, p.shard].add(p["pass"])
            assert 0 <= p.shard < len(starts) == 16
    assert len(slots) > 3 * 16
    taken = mixing.mix_report(df).agg(F.sum("taken")).first()[0]
    assert taken > 0
    whole = mixing.split_quotas
    nothing = F.transform("quotas", lambda x: F.struct(x["sid"].alias("sid"), F.lit(0).cast("long").alias("q")))
    monkeypatch.setattr(mixing, "split_quotas", lambda root, levels: whole(root, levels).withColumn("quotas", nothing))
    assert mixing.mix_report(df).agg(F.sum("taken")).first()[0] == 0


def test_targets_are_water_filled(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 300}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    open_, left, want = set(sizes), sum(sizes.values()), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 3 * sizes[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    assert got == pytest.approx(want)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), [float(x) for x in rng.normal(size=8) * rng.lognormal()]) for k in range(300)]
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, rows[0][1]), (305, rows[0][1]), (None, rows[1][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, stripe=64, block=8).collect()
    v = {k: np.floor(np.float32(x).astype(float) * 64).astype(int) for k, x in rows if k is not None and x and None not in x and np.isfinite(x).all()}
    for q in (k for k in v if k % 20 == 0):
        want = sorted((-int(v[q] @ x), k) for k, x in v.items() if k != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.query_id for r in got} == {k for k in v if k % 20 == 0}


def test_top_k_of_rows_that_share_an_id_or_a_vector(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 5.0]), (20, [0.0, 5.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (40, [1.0, 0.0]), (3, [7.0]), (60, [1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    answers = sorted((r.query_id, r["rank"], r.vec_id, r.score // 4096) for r in got)
    assert answers == sorted([(20, 1, 1, 2), (20, 2, 40, 1), (20, 1, 2, 10), (20, 2, 1, 0), (40, 1, 1, 2), (40, 2, 20, 1), (60, 1, 3, 7)])


@pytest.mark.parametrize("same", [False, True])
def test_top_k_over_many_stripes(spark, same):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(700, 6)) * (1 if same else rng.lognormal(0, 1.5, (700, 1)))
    v[100:350] = v[7] if same else v[100:350]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=5, stripe=50, block=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = np.floor(v * 64).astype(int)
    for q in range(0, 700, 5):
        scores = whole @ whole[q]
        want = sorted((-int(s), k) for k, s in enumerate(scores) if k != q)[:4]
        assert sorted(got.pop(q)) == [(i + 1, k, -s) for i, (s, k) in enumerate(want)]
    assert not got


def test_hot_keys_are_dealt(spark):
    from lemmaflow.llm.common import join_spread

    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 97 as string) end as key")
    keyed = rows.groupBy("key").count().selectExpr("key", "count as n", "upper(key) as name")
    out = join_spread(rows, keyed, "key", pieces=50)
    assert out.columns == ["key", "id", "name"]
    assert sorted((r.id, r.key, r.name) for r in out.collect()) == sorted((r.id, r.key, r.key.upper()) for r in rows.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_deal" in plan


#: Every name that an operator uses inside, as a column of the user's.
CLASHES = ["row", "key_id", "key_text", "gone", "lines", "left", "n_lines", "n_removed", "n_sentences", "spans", "start", "score", "_score", "_key_id", "fp", "node", "root", "set_id", "u", "sid", "order", "shard", "placements", "_deal", "hash", "pop", "n", "site", "none"]


@pytest.mark.parametrize("name", ["lines", "spans", "near", "toxic", "mix"])
def test_columns_of_any_name_come_back(spark, docs, name):
    import pyspark.sql.functions as F

    few = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    out = {
        "lines": lambda: lines.remove_cross_site_lines(few, min_sites=2), "spans": lambda: spans.remove_repeated_spans(few), "near": lambda: simhash.drop_near_duplicates(few),
        "toxic": lambda: toxicity.drop_toxic(few, labels), "mix": lambda: mixing.mix(few),
    }[name]()
    more = {"lines": ["n_lines_", "n_removed_"], "spans": ["n_sentences_", "n_removed_"]}.get(name, [])
    assert out.columns == few.columns + more
    rows = out.collect()
    assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASHES)


def test_quality_counts(docs):
    for r in quality.statistics(docs.where("doc_id is not null")).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        w = words(r.text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    rows = quality.quality_verdicts(docs).collect()
    assert len(rows) == docs.count() and all(not (r.kept and r.base_failed) for r in rows)
    assert quality.text_statistics(b"a #b\na #b\n\n$") == (5, 7, 3, 3, 1, 0)


def test_quality_limits_follow_each_group(spark):
    def text(k, repeated):  # 20 lines, `repeated` of them the same
        return "\n".join(["menu"] * (repeated + bool(repeated)) + [f"line{k}x{j} has own{k}y{j} words" for j in range(20 - repeated)])

    texts, sources = [], []
    for k in range(200):
        texts += [text(k, 6 if k % 50 == 0 else 0), text(k, 8)]
        sources += ["clean", "lists"]
    df = table(spark, texts, sources)
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(df).collect()}
    assert not any(got[2 * k] for k in range(0, 200, 50))  # 0.29 repeated lines, where others have none
    assert sum(not got[2 * k + 1] for k in range(200)) <= 12  # every list has 0.38
    report = {r.source: (r.docs, r.base_failed, r.limited) for r in quality.rejections(df).collect()}
    assert report["clean"][:2] == (200, 0) and report["clean"][2] == sum(not got[2 * k] for k in range(200))


def test_toxicity_learns(spark):
    rng = np.random.default_rng(9)
    plain = ["river", "stone", "cloud", "meadow", "window", "garden", "letter", "market"]
    texts = [" ".join([*rng.choice(plain, 30), *(["you worthless fool"] if k % 4 == 0 else [])]) for k in range(400)] + [None, ""]
    df = table(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(df, labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() >= 300
    none = toxicity.toxicity_scores(df, labels.where("false")).collect()
    assert all(r.predicted == 0 for r in none)


def test_licenses(spark):
    texts = ["Released under the MIT License. x", "MIT  license, apache-license", None, "", "This is the general public\nlicense", "under the Apache License, Version 2.0 - licensed under the Apache License, Version 2.0", LONG, "nothing of the kind"]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, texts + ["plain words only"] * 30)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels) == (1, 3, "mit", "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 2, "apache,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[4].base_labels == "gpl" and "apache-2.0" in got[5].labels and got[5].n_base == 2
    assert got[6].n_words == 30_000 and got[7].labels == ""


def test_a_file_with_all_notices_has_all_labels(spark):
    every = " and ".join(notice for _, notice, _ in licenses.TEMPLATES)
    many = "any can code copy file into source " * 50 + every
    common = sorted({w for _, notice, _ in licenses.TEMPLATES for w in notice.split()} - {"gnu", "general", "public", "license", "mit", "apache"})
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(table(spark, [every, many] + ["gnu general public license"] * 9 + [" ".join(common[:5])])).collect()}
    want = {label for label, _, _ in licenses.TEMPLATES}
    assert want <= set(got[0].split(",")) and want <= set(got[1].split(","))


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        simhash.simhash_components(none), simhash.drop_near_duplicates(none), lines.remove_cross_site_lines(none), spans.remove_repeated_spans(none),
        tokens.pack_tokens(none), packing.pack_minimum_slack(none), mixing.mix_report(none), mixing.mix(none), quality.quality_verdicts(none),
        toxicity.toxicity_scores(none, labels), licenses.scan_licenses(none), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.collect() == []


def _hard_negatives(rows, positives=5, k=5):
    """Brute force over (id, label, vector) rows of whole numbers."""
    out = []
    for a in {(i, l, v) for i, l, v in rows if i % 100 == 0}:
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        others = sorted({(-score(r), r[0], r) for r in set(rows) if r != a and len(r[2]) == len(a[2])})
        for low, i, r in [o for o in others if o[2][1] == a[1]][:positives]:
            fit = [o for o in others if o[2][1] != a[1] and 80 * -low <= 100 * -o[0] <= 100 * -low][:k]
            out += [(a[0], i, n + 1, o[1], -low, -o[0]) for n, o in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(4096, 4096), (50, 2)])
def test_hard_negatives_match_brute_force(spark, block, group):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(21)
    rows = [(k, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=3)]) for k in range(400)]
    rows += [(k, 1, [0.5, 0.25, 0.125]) for k in range(400, 440)]  # ties
    rows += [(100, 1, [0.0, 1.0, 0.0]), (100, 1, [0.0, 1.0, 0.0]), (-200, 2, [1.0, 1.0, 1.0]), (500, 1, [2.0, 1.0]), (501, 1, [1.0, 1.0]), (502, 0, [1.0, 1.5]), (600, 1, []), (601, 1, [])]
    rows += [(1000, 0, [0.0, 0.0, 0.0])]
    out = [(None, 1, [1.0, 1.0, 1.0]), (700, None, [9.0, 9.0, 9.0]), (800, 1, None), (801, 1, [9.0, None, 9.0]), (802, 1, [float("nan"), 9.0, 9.0]), (803, 1, [float("inf"), 9.0, 9.0])]
    table_ = spark.createDataFrame([(*r, "x", 1) for r in rows + out], "vec_id long, label int, embedding array<double>, h string, score int")
    got = negatives.hard_negatives(table_, anchors=F.col("id") % 100 == 0, label=F.when(F.col("id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label")), block=block, anchor_block=group)
    whole = [(i, l + (i % 7 == 0), tuple(int(np.floor(256 * x)) for x in v)) for i, l, v in rows]
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == _hard_negatives(whole)


def test_hard_negatives_of_great_numbers(spark):
    from pyspark.sql import functions as F

    great = [(0, 0, [2.0**20 + 1]), (1, 0, [2.0**21 + 1]), (2, 1, [2.0**21 - 1]), (3, 1, [2.0**21])]
    table_ = spark.createDataFrame(great, "vec_id long, label int, embedding array<double>")
    whole = [(i, l, tuple(int(256 * x) for x in v)) for i, l, v in great]
    assert sorted(map(tuple, negatives.hard_negatives(table_, anchors=F.col("id") == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == _hard_negatives(whole)
    beyond = spark.createDataFrame([(0, 0, [1e300]), (1, 0, [1e300]), (2, 1, [1e300])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="62 bits"):
        negatives.hard_negatives(beyond, anchors=F.col("id") == 0).collect()


@pytest.mark.parametrize("n,dim,same", [(1500, 8, False), (1500, 3, True), (40, 2, False), (1, 2, False)])
def test_cover_tree_covers(n, dim, same):
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (np.repeat(rng.normal(size=(n // 50 + 1, dim)), 50, axis=0)[:n] + (0 if same else 0.1) * rng.normal(size=(n, dim))))
    tree = negatives.cover_tree(rows)
    points = negatives.lifted(rows)[tree["order"]]
    assert sorted(tree["order"].tolist()) == list(range(n)) and (tree["start"][0], tree["stop"][0]) == (0, n)
    for k in range(len(tree["start"])):
        own = points[tree["start"][k] : tree["stop"][k]]
        assert tree["start"][k] <= tree["centre"][k] < tree["stop"][k]
        assert np.isclose(np.sqrt(((own - points[tree["centre"][k]]) ** 2).sum(axis=1)).max(), tree["radius"][k])
        low, high = tree["child"][k]
        if low < high:  # a node's children share out its rows
            assert (tree["start"][low], tree["stop"][high - 1]) == (tree["start"][k], tree["stop"][k])
            assert (tree["start"][low + 1 : high] == tree["stop"][low : high - 1]).all()
    one = np.array([2**62])
    best, seen = negatives.descend(tree, rows[tree["order"]], np.arange(n), np.ones(n, bool), rows[tree["order"]][0], -one, one, 1)
    assert best[0][0][0] == (rows @ rows[tree["order"]][0]).max()
    assert n < 1000 or seen < n / 2  # bounds skip most of clustered rows


def test_divergence_of_small_tables(spark):
    rows = [(None, "a\nb b", None, None), (1, "a A b", "en", "x"), (2, "a A b", "en", "x"), (3, "a c", "en", "y"), (4, None, "en", "z"), (5, "éé É 1", "fr", None), (6, "", "fr", "q")]
    df = spark.createDataFrame([(i, t, l, s, "k") for i, t, l, s in rows], "doc_id long, text string, lang string, source string, key string")
    got = {tuple(r) for r in divergence.source_divergence(df, min_docs=2, most_terms=1).collect()}
    # en keeps a (5 times) and b (2): x has 4 and 2, y has 1 and 0, z none
    share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 10)
    p = {"x": (share(4, 6), share(2, 6)), "y": (share(1, 1), share(0, 1)), "z": (share(0, 0), share(0, 0)), "": (share(5, 7), share(2, 7))}
    want = set()
    for a in "xyz":
        values = sorted((-sum(abs(u - w) for u, w in zip(p[a], p[b])), b) for b in "xyz" if b != a)
        want |= {("en", a, "pair", b, -v, k + 1) for k, (v, b) in enumerate(values)}
        above = sorted((-(u - w), t) for u, w, t, n in zip(p[a], p[""], "ab", {"x": (4, 2), "y": (1, 0), "z": (0, 0)}[a]) if n and u > w)
        want |= {("en", a, "term", t, -v, k + 1) for k, (v, t) in enumerate(above[:1])}
    want |= {("fr", "", "pair", "q", 0, 1), ("fr", "q", "pair", "", 0, 1)}
    assert got == want
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_deletes_its_counts(spark):
    from pathlib import Path

    texts = ["a b", "A\u212a \u0130z AB", "x" * 3, "\u00c9A \u00e9a", None]
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    df = spark.createDataFrame([(t, "en", f"s{k % 3}") for k, t in enumerate(texts * 8)], "text string, lang string, source string")
    rows = divergence.source_divergence(df, min_docs=2, most_terms=5)
    assert len({p for p in set(folder.iterdir()) - before if p.name.startswith("lemmaflow-")}) == 3  # languages, groups, shares
    assert rows.where("part = 'pair'").count() == 6
    counts = {(r.term, r.source): (r.n, r.docs) for r in divergence.term_counts(df).collect()}
    want = Counter((w, f"s{k % 3}") for k, t in enumerate(texts * 8) for w in ["".join(c.lower() if c < "\x80" else c for c in x) for x in (t or "").split()])
    assert {k: n for k, (n, _) in counts.items()} == want


def test_shuffles_go_when_a_table_is_written(spark):
    """The counts' shuffles are gone while the later steps of op13 run, and the session's settings are as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        blocks = disk.getAllBlocks()
        return {name for k in range(blocks.size()) if (name := blocks.apply(k).name()).startswith("shuffle_")}

    df = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} x", "en", f"s{k % 4}") for k in range(200)], "doc_id long, text string, lang string, source string")
    setting, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None), shuffles()
    table = common.durable(divergence.term_counts(df))
    for _ in range(40):
        if not shuffles() - before:
            break
        time.sleep(0.5)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert table.where("term = 'x'").agg({"n": "sum"}).first()[0] == 200
    common.forget(table)


def test_texts_reach_python_in_small_batches(spark):
    """A batch of long texts is a few MB while a table is written, and the texts that a stage scores come back in small batches."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat(id, ' ', repeat('some words ', 1000)) as text", "'x' as source")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    seen = common.durable(docs.mapInArrow(sizes, "rows long, size long"))
    assert seen.agg({"rows": "sum"}).first()[0] == 3000
    assert seen.agg({"size": "max"}).first()[0] < 2 * common.BATCH_BYTES
    batch = pa.RecordBatch.from_pydict({"text": [str(k) for k in range(1000)]})
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), 256))
    assert [p.num_rows for p in parts] == [256, 256, 256, 232] and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])


@pytest.mark.parametrize("name", ["op2_line_spread", "op7_topk", "op12_hard_negatives", "op13_source_divergence"])
def test_query_against_its_sql(spark, name):
    import duckdb

    from lemmaflow.llm import queries

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_top_k_never_wraps(spark):
    great = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    large = spark.createDataFrame([(0, [2.0**30, 0.0]), (1, [2.0**30, 1.0])], "vec_id long, embedding array<double>")
    for df in (great, large):
        with pytest.raises(Exception, match="62 bits"):
            topk.top_k(df).collect()


def test_rows_are_dealt_alike_in_any_order(spark):
    from pyspark.sql import functions as F

    from lemmaflow.llm.common import row_turn

    rows = spark.createDataFrame([(k, k % 3, {"m": k}) for k in range(300)], "u long, v long, m map<string,long>")
    deal = lambda df: {(r.u, r.v): r.t for r in df.withColumn("t", row_turn(df, F.lit(7))).collect()}
    assert deal(rows) == deal(rows.orderBy(F.desc("u")).repartition(5)) and len(set(deal(rows).values())) == 7


def test_pipeline_as_a_whole(spark, tmp_path):
    """All five stages over a small folder: what goes, what stays, and that packed pieces are whole documents."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 60)) + ("\nall sites have this line" if k < 30 else "") for k in range(240)]
    texts[100] = texts[7].replace("all sites", "all  sites")  # copies
    texts[101] = texts[8] + " more"
    toxic = {k for k in range(0, 200, 9)}
    for k in toxic:
        texts[k] = " ".join(rng.choice([*words[:40], "idiot", "scum", "pathetic"], 60))
    texts[230:234] = [None, "", "one", " ".join(words * 8)]
    docs = table(spark, texts, [f"s{k}" for k in range(12)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, stage = {}, docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        seen[name] = stage = stage.cache()
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert len(kept & toxic) <= 2 and len(set(range(240)) - toxic - kept) <= 6
    lined = {r.doc_id: r.text or "" for r in seen["line_dedup"].collect()}
    assert lined.keys() == kept and sum("all sites have this line" in t.split("\n") for t in lined.values()) == 1
    near = {r.doc_id for r in seen["simhash_near_dedup"].collect()}
    assert near <= kept and len(near & {8, 101}) == len({8, 101} & kept) - ({8, 101} <= kept)
    mixed = Counter(r.doc_id for r in seen["mixing"].collect())
    assert mixed.keys() <= near and max(mixed.values()) <= 3
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({(r.doc_id, r.piece, r["copy"]) for r in rows}) == len(rows)
    whole = Counter(r.doc_id for r in rows if r.piece == 0)
    assert whole == mixed
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = defaultdict(int)
    for r in rows:
        if r["copy"] == 0:
            assert r.start == lengths[r.doc_id] or r.piece > 0
            lengths[r.doc_id] += r.length


@pytest.mark.parametrize("words_", [1, 2])
def test_hamming_forest_in_many_blocks(spark, words_):
    """One large component over many blocks, and many small ones: the components of all pairs, with few edges between blocks."""
    from lemmaflow.llm.common import components

    rng = np.random.default_rng(17)
    middle = rng.integers(0, 2**63, words_, dtype=np.uint64)
    near = [middle ^ np.array([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, words_)]) for _ in range(150)]
    some = rng.integers(0, 2**63, (120, words_), dtype=np.uint64)
    all_ = {x.astype(">u8").tobytes() for x in [middle, *near, *some, *(some[:40] ^ np.uint64(5))]}
    prints = sorted(all_)
    nodes = spark.createDataFrame([(bytearray(x), sum(b.bit_count() for b in x)) for x in prints], "node binary, pop int")
    radius = 3 * words_
    edges = simhash.hamming_forest(nodes, radius, words_, least=8, pieces=40)
    value = [int.from_bytes(x) for x in prints]
    root = list(range(len(value)))
    for i in range(len(value)):
        for j in range(i):
            if (value[i] ^ value[j]).bit_count() <= radius:
                root = [root[j] if r == root[i] else r for r in root]
    want = {frozenset(prints[k] for k in range(len(root)) if root[k] == r) for r in set(root)}
    got = defaultdict(set)
    for r in components(edges).collect():
        got[bytes(r.root)].add(bytes(r.node))
    assert {frozenset(g) for g in got.values()} == {g for g in want if len(g) > 1}
    assert edges.count() < 4 * len(prints)
