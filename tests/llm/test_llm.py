"""The operators against brute force, round trips and edge cases, on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.llm import ann, bagminhash, exact_dedup, labelled, licenses, near_dedup, packing, quality, sentencepiece_codec, token_counts, token_files, toxicity
from quayside.llm.queries import QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, "naïve  \n\n text…"), (6, "x " * 30_000), (7, "\x00\t<|endoftext|> </s>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_exact_dedup(odd, docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for i, t in rows:
        groups[t].append(i)
    assert got == {(i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    kept = exact_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    # a digest that is the same for all texts changes nothing
    assert exact_dedup.exact_dedup(odd, digest=lambda t: F.lit("x")).where("kept").count() == 5
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 8, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == (1000 * bits + 7) // 8
    assert (token_files.unpack(data, 1000, bits) == ids).all()
    assert (token_files.unpack(data, 10, bits, 321) == ids[321:331]).all()


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_files_and_packing(spark, odd, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {i: ids for (i, _), ids in zip(rows, library([t for _, t in rows]), strict=True)}
    at, expected = 0, {}
    for i, ids in sorted(want.items()):
        expected[i] = (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes()))
        at += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_files"](spark, DATA).collect()} == expected
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_sequences(docs, tokenizer("byte_bpe_50k.json")).collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in pieces.items()} == {i: [*ids, 1] for i, ids in want.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)
    assert packing.pack_sequences(odd, tokenizer("byte_bpe_50k.json")).select("sequence_id").count() >= len(ODD)
    assert packing.pack_sequences(odd.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_best_fill_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = Counter(rng.integers(1, 30, 6).tolist())
        reach = {0}
        for length, n in counts.items():
            reach |= {r + length * k for r in reach for k in range(1, n + 1)}
        used = packing.best_fill(dict(counts), 40)
        assert sum(k * v for k, v in used.items()) == max(r for r in reach if r <= 40)
        assert all(v <= counts[k] for k, v in used.items())


def test_counts_and_codec(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = Counter(len(sp.encode(t or "")) for _, t in ODD)
    assert Counter(r.n_tokens for r in token_counts.count_tokens(odd, tokenizer("piece_bpe_32k.model"), limit=4096).collect()) == want
    encoded = sentencepiece_codec.encode_pieces(odd, tokenizer("piece_bpe_32k.model"))
    assert Counter(tuple(np.frombuffer(r.ids, dtype="<u4").tolist()) for r in encoded.collect()) == Counter(tuple(sp.encode(t or "")) for _, t in ODD)
    apart = sentencepiece_codec.decode_pieces(encoded, tokenizer("piece_bpe_32k.model"))
    together = sentencepiece_codec.round_trip_pieces(odd, tokenizer("piece_bpe_32k.model"))
    assert apart.columns == together.columns and Counter(map(tuple, apart.collect())) == Counter(map(tuple, together.collect()))


def similarity(a, b):
    def bag(t):
        w = ["".join(chr(c) for c in x).lower() for x in ()] or [x for x in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()]
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_near_dedup(spark, monkeypatch):
    rng, words = np.random.default_rng(4), [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(6):
        base = rng.choice(words, 80).tolist()
        for _ in range(25):
            copy = list(base)
            for k in rng.integers(0, 80, rng.integers(0, 5)):
                copy[k] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += ["", "...", "one two", "One, two!"]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: find(i) for i in range(len(texts))}
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    for rounds in (2, 0):  # without leaders everything goes through blocks
        assert {r.doc_id: r.group_id for r in near_dedup.near_dedup(df, leader_rounds=rounds).collect()} == want
    monkeypatch.setattr(near_dedup, "BROADCAST", 0)
    assert {r.doc_id: r.group_id for r in near_dedup.near_dedup(df).collect()} == want
    kept = near_dedup.keep_one_of_each(df)
    assert kept.count() == len(set(want.values())) and kept.columns == df.columns


def test_components(spark):
    from quayside.llm._common import Scratch
    from quayside.llm.graph import Sets, components

    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(50)] + [(7, 7)]
    sets = Sets()
    for a, b in links:
        if a != b:
            sets.join(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    for limit in (10_000, 4):  # in one task, and by contraction
        got = defaultdict(set)
        for r in components(df, Scratch(spark), limit).collect():
            got[r.component].add(r.node)
        want = defaultdict(set)
        for x in sets.parent:
            want[sets.root(x)].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert all(c in nodes for c, nodes in got.items())
    assert components(df.limit(0), Scratch(spark)).count() == 0


def test_near_dedup_loses_no_link(spark):
    """Groups of sf0.01 against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    t, s, c, _ = bagminhash.bags(pa.array([d.text or "" for d in docs]), 5)
    small = near_dedup.overlaps((t, s, c), (t, s, c), len(docs), len(docs))
    size = np.bincount(t, weights=c, minlength=len(docs))
    near = (small >= 0.8 * (size[:, None] + size[None, :] - small) - 1e-3) & (size > 0)[:, None]
    group = list(range(len(docs)))
    for i, j in np.argwhere(near).tolist():
        if group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    got = {r.doc_id: r.group_id for r in QUERIES["op6_minhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    want = {d.doc_id: docs[g].doc_id for d, g in zip(docs, group, strict=True) if size[g]}
    linked = {i for i in want if sum(v == want[i] for v in want.values()) > 1}
    assert linked and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == want[i] for i in want if i not in linked)


def test_block_overlaps():
    texts = pa.array(["a b c d e f " * 9, "a b c d e f " * 4, "x y z", "", "a b c d e g h"])
    t, s, c, _ = bagminhash.bags(texts, 5)
    edges = np.searchsorted(t, np.arange(6))
    one = [(s[edges[k] : edges[k + 1]], c[edges[k] : edges[k + 1]]) for k in range(5)]
    got = near_dedup.overlaps((t, s, c), (t, s, c), 5, 5)
    assert got.tolist() == [[float(bagminhash.overlap(a, b)) if len(a[0]) and len(b[0]) else 0.0 for b in one] for a in one]


def test_near_dedup_edges(odd):
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 5
    assert near_dedup.near_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "name", "remainder"), [(toxicity, "toxic", 5), (quality, "quality", 3)])
def test_classifiers(spark, odd, module, name, remainder):
    source, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labelled.crc_remainder("id", remainder) == (0 if name == "toxic" else 1)
    model = module.fit(source, labels, ~held)
    score = toxicity.score_toxicity if module is toxicity else quality.score_quality
    rows = score(source, model).join(labels, "doc_id").where(labelled.crc_remainder("doc_id", remainder) == (0 if name == "toxic" else 1)).collect()
    assert np.mean([(r.score >= 0.5) == (r[name] == 1) for r in rows]) >= 0.9
    assert all(0 <= r.score <= 1 for r in score(odd, model).collect())
    nothing = module.fit(source, labels.limit(0), ~held)
    assert score(odd, nothing).count() == len(ODD) and score(odd.limit(0), model).count() == 0
    drop = toxicity.drop_toxic if module is toxicity else quality.drop_poor
    assert drop(odd, model).columns == odd.columns


def test_toxic_terms_between_common_ends(spark):
    """Examples of a source with the same banner and signature are still different texts; copies count once."""
    ends = "This page was brought to you by the example archive. {} Signed, the editors of the example archive, all rights reserved."
    rude = [(k, 1, ends.format(f"You idiot number{k} said thing{k}.")) for k in range(40)]
    kind = [(100 + k, 0, ends.format(f"A garden number{k} has flower{k}.")) for k in range(40)]
    terms = toxicity.learn(spark.createDataFrame(rude + kind, "id long, y int, text string"))
    assert toxicity.fold("idiot") in terms or any(toxicity.fold("idiot").startswith(t) for t in terms)
    assert not any(toxicity.fold("archive").startswith(t) for t in terms)
    copies = [(k, 1, rude[0][2]) for k in range(40)]
    assert toxicity.learn(spark.createDataFrame(copies + kind, "id long, y int, text string")) == {}


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt")


def test_licenses(spark):
    rows = [(1, "Under the MIT License. mit license"), (2, "GNU General Public\nLicense"), (3, "gnu public license"), (4, None), (5, "It is licensed under a CC BY 4.0 deed")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 4, "mit")
    assert (got[2].base_labels, got[3].n_base, got[4].n_words, got[4].first_word) == ("gpl", 0, 0, None)
    assert got[5].labels == "cc-by,cc-by-4.0-notice" and got[5].score == 1.0


def test_nearest(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    ids = np.array([r.vec_id for r in rows.collect()])
    vectors = np.array([r.embedding for r in rows.collect()], dtype=np.float64)
    got = defaultdict(set)
    for r in ann.nearest(rows, F.col("id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [x for x in ids[np.lexsort((ids, d))] if x != q][:10]
        hits += len(got[q] & set(order))
    assert hits / (10 * len(got)) >= 0.9
    bad = spark.createDataFrame([(0, None), (100, [0.0, 0.0]), (200, [1.0, float("nan")])], "vec_id long, embedding array<double>")
    assert ann.nearest(bad, F.col("id") % 100 == 0).count() == 0


def test_nearest_where_few_rows_are_candidates(spark):
    """``least`` covers a fifth of the rows only, so ``share`` decides."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=np.float64)
    got = defaultdict(set)
    for r in ann.nearest(rows, F.col("id") % 4 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in ids[ids % 4 == 0]:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        hits += len(got[q] & set([x for x in ids[np.lexsort((ids, d))] if x != q][:10]))
    assert len(got) == (ids % 4 == 0).sum() >= 400 and hits / (10 * len(got)) >= 0.95


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [3.0, 0.0]), (5, [1.0, 0.0, 0.0]), (200, [1.0, 0.5, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, shard int, score int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    # both vectors of id 0 are asked; the equal vectors of 100 and 3 tie, the smaller id first; a dimension is searched by itself
    near = [(3, 0.0), (3, 0.0), (100, 0.0), (2, 2.0)]
    far = [(3, 5**0.5), (3, 5**0.5), (100, 5**0.5), (2, 13**0.5)]
    assert sorted(got[0]) == sorted([(k + 1, *x) for k, x in enumerate(near)] + [(k + 1, *x) for k, x in enumerate(far)])
    assert got[100] == [(1, 0, 0.0), (2, 3, 0.0), (3, 3, 0.0), (4, 2, 2.0), (5, 0, 5**0.5)]
    assert got[200] == [(1, 5, 0.5)]
    assert ann.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_token_files_edges(spark, odd):
    shards = token_files.write_token_files(odd, tokenizer("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    want = Counter((i, tuple([*ids, 2])) for (i, _), ids in zip(ODD, library([t for _, t in ODD]), strict=True))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, dtype="<u4").tolist())) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0), tokenizer("byte_bpe_50k.json"))).count() == 0


def test_prefix_counts(spark):
    import sentencepiece

    path, limit = tokenizer("piece_bpe_32k.model"), 6
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "a", "Some words, and  more: 12345!", "naïve…\n\n文字 x", " leading", "</s> <unk> s", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.count_tokens(df, path, limit=limit, with_prefixes=True).collect():
        t = texts[r.doc_id] or ""
        counts = [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert r.prefix_counts == counts and r.n_tokens == counts[-1]
        assert (r.n_bytes, r.over_limit, r.fits_chars) == (len(t.encode()), counts[-1] > limit, max(k for k, c in enumerate(counts) if c <= limit))
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def unigram_model(path):
    """A small unigram model, put together by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    kinds = pb.ModelProto.SentencePiece
    pieces = [("<unk>", 0.0, kinds.UNKNOWN), ("<s>", 0.0, kinds.CONTROL), ("</s>", 0.0, kinds.CONTROL)] + [(f"<0x{b:02X}>", -30.0, kinds.BYTE) for b in range(256)]
    pieces += [("▁", -2.0, kinds.NORMAL), ("▁dog", -3.0, kinds.NORMAL), ("s", -3.5, kinds.NORMAL), ("▁do", -5.0, kinds.NORMAL), ("gs", -6.0, kinds.NORMAL), ("▁the", -2.5, kinds.NORMAL)]
    pieces += [(c, -8.0 - k / 10, kinds.NORMAL) for k, c in enumerate("abcdefghijklmnopqrtuvwxyz")]
    for piece, score, kind in pieces:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = pb.TrainerSpec.UNIGRAM, True, len(pieces)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram(spark, tmp_path):
    import sentencepiece

    path = unigram_model(tmp_path / "unigram.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the dogs", "dog", "", None, "über dog\nx", "the  dogs do"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece_codec.round_trip_pieces(df, path).collect()}
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k].ids, dtype="<u4").tolist() == sp.encode(t or "")
        assert got[k].decoded == (t or "") and got[k].n_repaired == 0
    assert sentencepiece_codec.round_trip_pieces(df.limit(0), path).count() == 0


def test_licenses_against_plain_search(spark, odd):
    """Phrases by comparing words at every place, templates by a regular expression over the words."""
    import re

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    full = licenses.TEMPLATES["zlib-text"].replace("<<beginOptional>>", "").replace("<<endOptional>>", "").replace("<<var;max=1>>", "1.")
    rows += [(-1, full), (-2, full.replace("plainly", "")), (-3, "mit license " * 20_000), (-4, licenses.TEMPLATES["unlicense-text"].replace("<<var;max=6>>", "AUTHORS"))]

    def pattern(template):
        out, at = "", 0
        for m in [*licenses._MARK.finditer(template), None]:
            out += "".join(f" {w.decode()}" for w in licenses.words_of(template[at : m.start() if m else len(template)]))
            if m:
                at = m.end()
                out += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else f"(?: [^ ]+){{0,{m[2]}}}"
        return re.compile(out + r"(?= )")

    templates = {name: pattern(t) for name, t in licenses.TEMPLATES.items()}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = [w.decode() for w in licenses.words_of(t or "")]
        places = {(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()}
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = {label for _, label in places}
        whole = f" {' '.join(words)} "
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | {name for name, p in templates.items() if p.search(whole)})), i
    assert "zlib-text" in got[-1].labels and "zlib-text" not in got[-2].labels and "unlicense-text" in got[-4].labels
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(odd.limit(0)).count() == 0


def test_lexicon_against_plain_search():
    terms = {toxicity.fold("idiot"): 2.0, toxicity.fold("idiot")[:5]: 1.0, " trash ".replace("l", "i"): 1.5, " sc": 0.7}
    lexicon = toxicity.Lexicon(terms, 1.0, 0.0)
    for text in ["An 1D10T, idiots and trash", "the trash can is full of trash", "scum line or scum", "", "!!! @", "idiot proof idiot " * 500, "ｉｄｉｏｔ"]:
        folded = toxicity.fold(text)
        free = set()
        for e in map(toxicity.fold, toxicity.EXCEPTIONS):
            free |= {p for k in range(len(folded)) if folded.startswith(e, k) for p in range(k, k + len(e) - 1)}
        best = [max((w for t, w in terms.items() if folded.startswith(t, k)), default=0.0) for k in range(len(folded)) if k not in free]
        weight, hits, n = lexicon.weight(text)
        assert (round(weight, 6), hits, n) == (round(sum(best), 6), sum(b > 0 for b in best), len(folded.split()))


def test_votes_against_plain_search(spark, docs):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(source, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), F.lit(True))
    texts = pa.array([r.text or "" for r in docs.collect()][:60] + [""])
    got = model.score(texts)
    latent = model.weigh(quality.features(texts), model.idf) @ model.basis
    for k, v in enumerate(latent):
        cosine = [float(v @ x) / max(1e-12, float(np.linalg.norm(v))) for x in model.vectors]
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: model.k]
        weight = [max(1e-6, cosine[i]) ** model.power for i in near]
        want = 0.5 if not texts[k].as_py() else sum(w * model.votes[i] for w, i in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[k] - want) < 0.02
    again = quality.fit(source.repartition(7), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), F.lit(True))
    assert (again.vectors == model.vectors).all() and (again.votes == model.votes).all()


def test_one_row_for_each_labelled_id(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, labelled.sample(docs, labels, "toxic", F.lit(True), 10).collect())) == [(1, 1, "a"), (2, 0, "")]


def test_pipeline_edges(spark, odd, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    more = [(i, t, "en", "web", 1) for i, t in ODD] + [(9, "a b c d e f", None, None, None)]
    for name, rows in (("odd", more), ("empty", [])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        # no example is learned from, so nothing is toxic or poor; one of each text stays, the largest id
        assert {r.doc_id for r in got} == ({2, 9, 5, 6, 7} if rows else set())


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA).collect()
    ids = {r.doc_id for r in got}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    texts = [docs[i] for i in ids]
    assert 0 < len(ids) < len(docs) and len(texts) == len(set(texts))
