"""Repeat removal, alignment and spelling variants against brute force, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import alignment, repeats, spelling
from quayside.llm.queries import ORACLE_SQL, QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, ""), (2, None), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, "naïve  \n\n text…"), (6, "x " * 3000), (7, "\x00\t<|endoftext|> </s> <unk>"),
    (8, "lower ▁ mark"), (9, "日本語 text 漢字"), (10, " lead and trail "), (11, "Word" * 500), (12, "🙂🙂é"), (13, "a b c d e f, and many more words that repeat in the next of these texts"),
    (14, "Other words; and many more words that repeat in the next of these texts"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("block", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def removed(rows, width):
    first = {}
    rank = lambda i: repeats.NO_ID if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(rank(i), first.get(b[p : p + width], repeats.NO_ID))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < rank(i):
                gone[p : p + width] = b"\1" * width
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        out.append((str(i), len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def spans_of(df):
    return sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("letters, length, width, hot", [("ab", 80, 8, 512), ("abcé ", 200, 50, 1), ("a", 200, 50, 1), ("abcdefgh", 300, 64, 512), ("ab", 40, 2, 2), ("abcdefgh", 100, 7, 1)])
def test_repeats_of_random_texts(spark, letters, length, width, hot):
    rnd = random.Random(width)
    base = ["".join(rnd.choices(letters, k=rnd.randint(0, length))) for _ in range(40)]
    rows = []
    for i in range(40):
        text, other = rnd.choice(base), rnd.choice(base)
        if rnd.random() < 0.5:
            text = text[: rnd.randint(0, len(text))] + other[rnd.randint(0, len(other)) :]
        rows.append((rnd.choice([None, i, i, i, i % 7]), rnd.choice([None, text, text, text, text])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert spans_of(repeats.remove_repeats(df, width, hot_blocks=hot)) == removed(rows, width)


def test_repeats_of_odd_texts(spark, odd):
    assert spans_of(repeats.remove_repeats(odd)) == removed(ODD, 50)
    assert repeats.remove_repeats(odd.limit(0)).count() == 0
    # a text longer than a block, and its copy within another
    long = "".join(random.Random(1).choices("abcdefghij ", k=1_300_000))
    got = spans_of(repeats.remove_repeats(spark.createDataFrame([(1, long), (2, "x" + long[5:] + "y"), (3, long)], "doc_id long, text string")))
    assert [(n, spans) for _, n, spans, _ in got] == [(len(long), ()), (len(long) - 3, ((1, len(long) - 4),)), (len(long), ((0, len(long)),))]


def test_repeats_query(spark, docs):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = duckdb.sql(ORACLE_SQL["op11_repeat_removal"]).fetchall()
    got = [tuple(r) for r in QUERIES["op11_repeat_removal"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    by_hand = [(int(i), n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in removed(rows, 50)]
    assert sorted(got) == sorted(by_hand)


def aligned(rows):
    """By comparing all pairs of tokens of a text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    to_byte, docs, seen = alignment._byte_level(), [], Counter()
    for i, t in rows:
        text, a, b, groups, links = " " + (t or ""), [], [], [], []
        if t:
            a, b = a_lib.encode(text, add_special_tokens=False).ids, b_lib.encode(t)
        spelled_a = [bytes(to_byte[c] for c in a_lib.id_to_token(x)) for x in a]
        spelled_b = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if b"".join(spelled_a) != text.encode() or b"".join(spelled_b) != text.encode():
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a, ends_b = np.cumsum([0, *map(len, spelled_a)]).tolist(), np.cumsum([0, *map(len, spelled_b)]).tolist()
        k = 0
        for j, x in enumerate(a):
            while k < len(b) and ends_b[k + 1] <= ends_a[j]:
                k += 1
            for m in range(k, len(b)):
                if ends_b[m] >= ends_a[j + 1]:
                    break
                links.append((x, b[m]))
        common = sorted((set(ends_a) & set(ends_b)) - {0})
        for s, e in zip([0, *common], common, strict=False):
            inside = lambda ids, ends, s=s, e=e: ",".join(str(x) for x, end in zip(ids, ends[1:], strict=True) if s < end <= e)
            groups.append(f"{inside(a, ends_a)}|{inside(b, ends_b)}")
        docs.append((i, a, b, groups, links))
        seen.update(set(links))
    best = defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((str(i), len(a), len(b), len(groups), len(links), text, digest, sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links)))
    return sorted(out)


@pytest.mark.parametrize("unit, max_pairs", [(alignment.UNIT, alignment.PAIRS), (500, alignment.PAIRS), (alignment.UNIT, 0)])
def test_alignment(spark, odd, docs, unit, max_pairs):
    both = odd.select("doc_id", "text").unionByName(docs.where("doc_id < 30").select("doc_id", "text"))
    out = alignment.align(both, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), with_groups=True, unit=unit, max_pairs=max_pairs)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.groups_sha256, r.n_best, r.count_sum) for r in out.collect())
    assert got == aligned([(r.doc_id, r.text) for r in both.collect()])
    assert alignment.align(odd.limit(0), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), max_pairs=max_pairs).count() == 0


def test_alignment_query(spark, docs):
    got = QUERIES["op12_alignment"](spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert got.count() == docs.count() and got.where("n_a = 0").count() == docs.where("coalesce(text, '') = ''").count()
    # count_sum adds up, over pairs, links times documents; with one document each link counts once
    one = alignment.align(docs.where("doc_id = 1"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).first()
    assert one.count_sum == one.n_links == one.n_best > 0


def variants(rows, min_count=5, ratio=5, every=199):
    """By spelling out each word's edits."""
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= min_count}
    letters = sorted(set("".join(n)))
    form, near = {}, {}
    for w in n:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        near[w] = (edits & n.keys()) - {w}
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), f or "", n.get(f, 0), root))
    return sorted(out)


def listed(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("hot", [spelling.HOT, 1])
def test_spelling_variants(spark, docs, hot):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = variants(rows, min_count=2, every=7)
    assert listed(spelling.spelling_variants(docs, min_count=2, every=7, hot=hot)) == want
    assert any(root != form != "" for _, _, _, form, _, root in want)


def test_spelling_of_odd_texts(spark, odd):
    lines = [(k, w) for w, n in {"kitten": 800, "kittens": 150, "kittenss": 25, "mitten": 160, "kittén": 5, "itten": 900, "STRASSE": 5, "straße": 30, "straÞe": 6, "aaaaaa": 5, "aaaaaaa": 25, "×÷×÷×÷": 5}.items() for k in range(n)]
    rows = [*lines, *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    for hot in (spelling.HOT, 1):
        got = listed(spelling.spelling_variants(df, hot=hot))
        assert got == variants(rows) and ("kittenss", got[[g[0] for g in got].index("kittenss")][1]) in [g[:2] for g in got]
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    assert listed(spelling.spelling_variants(odd)) == variants(ODD)


def test_spelling_query(spark, docs):
    assert listed(QUERIES["op13_spelling_variants"](spark, DATA)) == variants([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("name", ["op3_sentencepiece", "op4_packing", "op5_token_counts", "op7_license_scan", "op8_toxicity", "op9_nearest_neighbours", "op10_quality"])
def test_registered_queries_cover_their_tables(spark, name):
    got = QUERIES[name](spark, DATA)
    if name == "op9_nearest_neighbours":
        vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
        assert got.select("query_id").distinct().count() == vectors.where("vec_id % 100 = 0").count()
        assert got.groupBy("query_id").count().where("count <> 10").count() == 0
        return
    ids = got.select("doc_id").distinct() if name == "op4_packing" else got.select("doc_id")
    assert sorted(r[0] for r in ids.collect()) == list(range(200))
    if name in ("op8_toxicity", "op10_quality"):
        every, left = (5, 0) if name == "op8_toxicity" else (3, 1)
        for r in got.collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % every == left) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
